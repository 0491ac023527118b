"""Quality classifier, HTML text, masked language model and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from utterlake.llm import additive_model, fingerprints, html_text, masked_lm

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in additive_model.classify(d, l).collect()}
    assert len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in l.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_classifier_edges(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0)], "doc_id long, text string, x int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in additive_model.classify(d, none).collect()} == {0.5}
    assert additive_model.classify(d.limit(0), none).collect() == []


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 8))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = additive_model.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.8
    slow = [m.intercept + sum(t[int((e <= v).sum())] for e, t, v in zip(m.edges, m.tables, row)) + sum(t[int((m.pair_edges[a] <= row[a]).sum()), int((m.pair_edges[b] <= row[b]).sum())] for a, b, t in m.pairs) for row in x[:50]]
    assert np.allclose(m.score(x[:50]), 1 / (1 + np.exp(-np.array(slow))))


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two <b>bold</b>, x<div>three</div>", "one\n\ntwo bold, x\n\nthree"),
    ("<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul>after", "- a\n- b\n  3. c\n  4. d\n\nafter"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>end", "name       n\nlong name  1\n\nend"),
    ("<div style='display: none'>x</div><p hidden>y</p><script>a<b</script>z<!-- c --><template>t</template>", "z"),
    ("<head><title>t</title></head><body>a<br>b<br><br>c<hr>d", "a\nb\n\nc\n---\nd"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("<p>a</i></p></div>b <img alt='pic'> c", "a\n\nb pic c"),
    ("<td>x</td><a href=\"a>b\">l</a> <<< 1 < 2", "x l <<< 1 < 2"), ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("<table><tr><td colspan=2>w<td>x<tr><td>1<td>2<td><table><tr><td>i<td>j</table></table>", "w     x\n1  2  i  j"),
    ("<div>" * 5000 + "deep", "deep"), ("<style>p{", ""), ("<!-- open", ""),
    ("<p title=\"x>hello<p>there", "hello\n\nthere"), ("<p title='x>a</p><b class=\"y\">c</b>", "a\n\nc"), ("a <b", "a"), ("<p a=1 b = '2>3' c/>x", "x"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>z", "yes\n\nz"), ("<p aria-hidden=true>seen", "seen"),
    ("a<select><option>one<option selected>two</select>b", "a\n\none\ntwo\n\nb"), ("<svg><title>t</title><text>in a picture</text></svg>", "in a picture"), ("<math><mi>x</mi></math>", "x"),
    ("<input type=hidden value=h><input value='typed'>", "typed"), ("<textarea>a &lt;b></textarea>", "a <b>"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=1000>a<td>b</table>", "a  b"), ("<table><tr><td>" + "w " * 40 + "<td>x<tr><td>y<td>z</table>", "w " * 39 + "w  x\ny  z"),
])
def test_html(html, text):
    assert html_text.text_of(html) == text


class Plain(HTMLParser):
    """All text that isn't inside what is never shown; for well-formed pages."""

    NEVER = ("head", "script", "style", "template", "noscript")

    def __init__(self):
        super().__init__()
        self.hidden, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.NEVER

    def handle_endtag(self, tag):
        self.hidden -= tag in self.NEVER

    def handle_data(self, data):
        if not self.hidden:
            self.said.append(data)


def letters(text):
    return re.findall(r"[^\W\d_]+", text)


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    return " ".join(p.said)


def test_html_against_another_parser(spark, sf_dir):
    """The same words in the same order as the standard library's parser finds, on the pages and on made trees."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").collect():
        assert letters(html_text.text_of(r.html)) == letters(plain(r.html))
    rng = random.Random(3)
    names = iter(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17576))

    def tree(depth):
        kind = rng.choice(["p", "div", "span", "b", "ul", "table", "pre", "script", "text", "text", "h1", "blockquote"])
        if not depth or kind == "text":
            return f" {next(names)} "
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{tree(depth - 1)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td rowspan={rng.choice((1, 1, 2))} colspan={rng.choice((1, 1, 3))}> {next(names)} </td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if kind == "script":
            return f"<script>{next(names)}</script>"
        inside = " ".join(tree(0 if kind in ("p", "h1", "pre") else depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{kind} title='{next(names)}'>{inside}</{kind}>"

    for _ in range(60):
        html = "<html><head><title>no</title></head><body>" + "".join(tree(4) for _ in range(3)) + "</body></html>"
        assert letters(html_text.text_of(html)) == letters(plain(html))


@pytest.mark.parametrize("html", [
    "<a " * 200_000, "<p title=\"" * 100_000, "<p title='x" * 50_001, "<div>" * 100_000 + "</p>" * 50_000, "<p>" + "<div>" * 50_000 + "<li>" * 20_000, "<" * 500_000, "<ul><li>" * 30_000,
    "<table><tr><td>a<td colspan=1000>b<td>" * 3000, "<table>" + "<tr><td>a<td colspan=1000>b<td>c" * 3000 + "<tr><td>" + "w" * 90_000 + "</table>", "<table><tr>" + "<td rowspan=65534>x" * 3000 + "<tr><td>y" * 300 + "</table>",
    "<script>" * 50_000, "<!--" * 100_000, "<textarea>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000, "&amp" * 100_000, "<select><option>" * 30_000,
])
def test_html_bad_pages_take_no_square(html):
    began = time.process_time()
    text = html_text.text_of(html)
    assert time.process_time() - began < 8 and len(text) < 20 * len(html) + 5000


def test_html_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html_text.extract(p).collect()
    assert len(rows) == p.count() and all("track(" not in r.text and "<div" not in r.text for r in rows)
    assert html_text.extract(p.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "<p>a", "t", 3), (1, "<p>a", "t", 3), (None, None, "t", 3), (2, "", "t", 3), (3, "<p>" + "b " * 300_000, "t", 3)], "page_id long, html string, text string, n_chars long")
    got = Counter((r.page_id, r.text[:3], r.n_chars) for r in html_text.extract(odd).collect())
    assert got == Counter([(1, "a", 1), (1, "a", 1), (None, "", 0), (2, "", 0), (3, "b b", 599_999)])


def test_masked_lm_edges(spark):
    said = " ".join(["the cat sat on the mat and"] * 40)
    rows = [(i, said, 1) for i in range(30)] + [(90, None, 1), (91, "", 1), (93, " \n", 1), (None, said, 1), (0, said, 1), (92, "zzz qqq " * 50, 1), (94, "x" * 400_000 + " y" * 300_000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = masked_lm.score(d).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_tokens == 0 and by[i].perplexity is None and by[i].log_prob == 0 for i in (90, 91, 93))
    assert {(r.n_tokens, r.log_prob) for r in got if r.doc_id is None or r.doc_id < 90} == {(280, by[0].log_prob)} and by[94].n_tokens == 300_001
    assert by[0].perplexity < by[92].perplexity
    assert masked_lm.score(d.limit(0)).collect() == []


def test_masked_lm_against_brute_force(spark, sf_dir, monkeypatch):
    """Class probabilities from the network, word probabilities from counts; every word's own, adding up to 1."""
    flat = np.random.default_rng(5).normal(0, 0.4, len(masked_lm.start(np.ones(masked_lm.CLASSES))))
    monkeypatch.setattr(masked_lm, "train", lambda table, counts: flat)
    monkeypatch.setattr(masked_lm, "PER_BUCKET", 5000)
    monkeypatch.setattr(masked_lm, "PART", 30_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    n = Counter(w for t in rows.values() for w in t)
    words = fingerprints.words(pa.array([" ".join(w.decode() for w in n)]))
    kind = dict(zip(n, masked_lm.classes(words).tolist(), strict=True))
    size = Counter()
    for w, c in n.items():
        size[kind[w]] += c
    assert sum(n[w] / size[kind[w]] for w in n) == pytest.approx(len(size))
    p = masked_lm.unpack(flat.astype(np.float32).astype(np.float64))
    got = {r.doc_id: r for r in masked_lm.score(docs.repartition(3)).collect()}
    assert got.keys() == rows.keys()
    for i, t in list(rows.items())[:40]:
        c = [masked_lm.EDGE] * 2 + [kind[w] for w in t] + [masked_lm.EDGE] * 2
        total = 0.0
        for k, w in enumerate(t, 2):
            h = np.tanh(np.concatenate([p["e"][c[k + r]] for r in masked_lm.REACH]) @ p["w"] + p["b"]) @ p["c"] + p["d"]
            total += h[c[k]] - np.log(np.exp(h).sum()) + np.log(n[w] / size[kind[w]])
        assert got[i].n_tokens == len(t) and got[i].log_prob == pytest.approx(total, abs=1e-5 * len(t) + 1e-3)


def test_masked_lm_learns_and_partitions_do_not_matter(spark, monkeypatch):
    """Held-out class loss well below that of class frequencies, and so word loss below that of word frequencies, by the same shards however the rows are dealt."""
    monkeypatch.setattr(masked_lm, "SHARD", 60_000)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    half = d.where("doc_id % 2 = 0")
    rest = [r.text for r in d.where("doc_id % 2 = 1").collect()]
    w = fingerprints.words(pa.array(rest))
    c = masked_lm.classes(w)
    texts = [c[a:b].tobytes() for a, b in zip(w.first, w.first[1:])]
    found = []
    for parts in (1, 8, 32):
        table = masked_lm.packed(half.repartition(parts), 1_000_000, "doc_id", "text")
        counts = masked_lm.class_counts(table)
        assert counts.sum() > 2 * masked_lm.SHARD
        found.append(masked_lm.train(table, counts))
        share = np.log(counts + 0.5) - np.log((counts + 0.5).sum())
        plain = -share[c].mean()
        loss = -masked_lm.scores(masked_lm.unpack(found[-1].astype(np.float32)), texts, np.zeros(masked_lm.CLASSES)).sum() / len(c)
        assert loss < plain - 0.4
    assert np.allclose(found[0], found[1], atol=1e-4) and np.allclose(found[0], found[2], atol=1e-4)
    one, many = ({r.doc_id: r.log_prob for r in masked_lm.score(half.repartition(k)).collect()} for k in (1, 8))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 0.01 for i in one)


def test_masked_lm_trains_on_every_position():
    texts = [np.random.default_rng(i).integers(0, 256, 700 * i).astype(np.uint8).tobytes() for i in range(4)]
    for _, tokens, owner in masked_lm.runs(texts):
        turns = np.concatenate([masked_lm.masked(tokens, owner, t) for t in range(masked_lm.ROUNDS)])
        assert sorted(turns.tolist()) == np.flatnonzero(owner >= 0).tolist()


def test_masked_lm_gradient():
    r = np.random.default_rng(1)
    flat = r.normal(0, 0.3, len(masked_lm.start(np.ones(256))))
    around, target = r.integers(0, 257, (20, 4)), r.integers(0, 256, 20)
    loss = lambda x: -masked_lm.log_probs(masked_lm.unpack(x), around, target).mean()
    g = masked_lm.gradient(masked_lm.unpack(flat), around, target)
    for i in [*r.choice(len(flat), 60, replace=False).tolist(), int(around[0, 0]) * masked_lm.VECTOR]:
        x, y = flat.copy(), flat.copy()
        x[i] += 1e-5
        y[i] -= 1e-5
        assert (loss(x) - loss(y)) / 2e-5 == pytest.approx(g[i], abs=1e-7)
    every = np.exp(masked_lm.log_probs(masked_lm.unpack(flat), around[:1].repeat(256, 0), np.arange(256))).sum()
    assert every == pytest.approx(1, abs=1e-9)


def test_pipeline(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = corpus_pipeline.quality(spark, d, sf_dir)
    assert step.columns == d.columns
    one = corpus_pipeline.near_duplicates(spark, step, sf_dir)
    assert one.columns == d.columns
    two = corpus_pipeline.secrets(spark, one, sf_dir)
    assert two.columns == d.columns and two.count() == one.count()
    assert not [r for r in two.collect() if re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) or r.n_chars != len(r.text)]
    assert corpus_pipeline.mix(spark, two, sf_dir).columns == d.columns
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in one.collect()}


def test_pipeline_stages_with_odd_rows(spark, sf_dir):
    """Null, empty and repeated texts, null ids and sources, extra columns with clashing names; and an empty table."""
    r = random.Random(9)
    good = " ".join("".join(r.choices("abdeilmnorstu", k=r.choice((4, 5, 6)))) + "." * (i % 12 == 11) for i in range(150))
    rows = [(1, good, "s0"), (2, good, None), (2, good, None), (None, good + " More.", "s1"), (3, None, "s0"), (4, "", "s0"), (5, " \n", None), (6, "token = abcdef0123456789 " + " ".join(reversed(good.split())), "s0")]
    made = [(i, "http://x", "en", s, t, len(t or ""), 1, "k", 2) for i, t, s in rows]
    d = spark.createDataFrame(made, "doc_id long, url string, lang string, source string, text string, n_chars long, n long, k string, target long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, sf_dir)
        out = got.collect()
        assert stage(spark, d.limit(0), sf_dir).collect() == []
        if name == "quality_rules":
            assert Counter(r.doc_id for r in out) == Counter([1, 2, 2, None, 6])
        elif name == "near_duplicates":
            assert Counter((r.doc_id, r.text) for r in out) == Counter([(None, good + " More."), (3, None), (4, ""), (5, " \n"), (6, rows[-1][1])])
        elif name == "secrets":
            assert len(out) == len(rows) and {r.text for r in out if r.doc_id == 6} == {"[SECRET] " + " ".join(reversed(good.split()))}
            assert [r.text for r in out if r.doc_id in (3, 4, 5)].count(None) == 1
        elif name == "mixture":
            assert {r.doc_id for r in out} <= {r[0] for r in rows}
        else:
            assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows) and all(r.length >= 1 for r in out)
        if name != "packing":
            assert got.columns == d.columns
