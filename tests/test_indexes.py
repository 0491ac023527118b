"""Posting lists that change, running totals by ranges, and packed n-gram models, against rebuilds and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from utterlake.operators import postings, search
from utterlake.plans import mining
from utterlake.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_three_batches_equal_a_rebuild(spark, tmp_path):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["there", "Theré", "other", "then", "x", "月台"]) for _ in range(r.randint(0, 12)))
    docs = {i: text() for i in range(60)} | {98: None, 99: ""}
    frame = lambda: spark.createDataFrame(list(docs.items()), "id long, text string")
    index = postings.PostingIndex(spark, str(tmp_path / "ix"))
    assert index.sync(frame(), "id", "text") == 62 and index.sync(frame(), "id", "text") == 0
    docs |= {i: text() + " new" for i in range(0, 60, 7)}
    del docs[5]
    assert index.sync(frame(), "id", "text") == 10
    docs |= {200: "over there", 5: "there again"}
    assert index.sync(frame(), "id", "text") == 2
    again = postings.PostingIndex(spark, str(tmp_path / "ix"))
    for phrase in ("there", "théré", "月台", "re", "x"):
        got, want, scan = (search.phrase_search(i, frame(), "id", "text", phrase, sizes=s).collect() for i, s in ((again.live(), again.sizes()), (search.postings(frame(), "id", "text"), None), (None, None)))
        assert got == want == scan
    assert sorted(map(tuple, again.live().collect())) == sorted(map(tuple, search.postings(frame(), "id", "text").collect()))


def test_segments_of_one_size_are_merged_and_void_postings_go(spark, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path / "ix"))
    for k in range(4):
        index.sync(spark.createDataFrame([(1, f"text {k}")], "id long, text string"), "id", "text", whole=False)
    segments = [e for e in index.entries() if e[0] == "segment"]
    assert len(segments) == 1 and segments[0][2] == 4  # tex, ext, xt_, t_3


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path / "ix"))
    assert index.live().count() == 0 and index.sync(spark.createDataFrame([], "id long, text string"), "id", "text") == 0


def test_lists_have_each_posting_once(spark):
    texts = ["there the", None, "", "ab", "É月台\U0001f600x", "a\0\0\0b", "\0" * 5, "aaaa", "THE"] * 5
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    want = sorted(map(tuple, search.postings(d, "id", "text").collect()))
    for most in (1 << 21, 30, 0):
        lists = search.posting_lists(d, "id", "text", most).collect()
        assert sorted((r.gram, i) for r in lists for i in r.ids) == want
        assert most < 1 << 21 or len(lists) == len({g for g, _ in want})
    codes = np.array([0x10FFFF, 0x10FFFE, 0x10FFFD, 97] * 3, np.uint32)  # three times 21 bits leave none for a text's number
    assert sorted((g, int(r)) for gs, at, rows in search.gram_lists(codes, np.array([0, 4, 8, 12])) for g, a, b in zip(gs, at, at[1:]) for r in rows[a:b]) == sorted(
        (t, i) for i in range(3) for t in ("\U0010ffff\U0010fffe\U0010fffd", "\U0010fffe\U0010fffda"))


def test_a_segment_is_made_once(spark, tmp_path):
    """As lists, dealt by trigram: no range has to be sampled, no posting is joined."""
    index = postings.PostingIndex(spark, str(tmp_path / "ix"))
    index.sync(spark.range(300).selectExpr("id", "'over there' as text"), "id", "text")
    (name, n), = [(e[1], e[2]) for e in index.entries() if e[0] == "segment"]
    rows = spark.read.schema(postings.SEGMENT).parquet(f"{tmp_path}/ix/{name}")
    assert n == 300 * 8 and rows.count() <= 8 * 16 and sorted({r.gram for r in rows.collect()}) == sorted({"over there"[i : i + 3] for i in range(8)})


def test_running_totals(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.randint(0, 2), i, r.choice([1.5, 2.0, None])) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, day int, hour int, i int, v double")
    got = {x.i: (x.within, x.total) for x in q.running_totals(d, ["k"], "day", "hour", ["i"], "v").collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])
    for k, day, hour, i, _ in rows:
        upto = [x for x in rows if x[0] == k and order(x) <= order((k, day, hour, i))]
        assert got[i] == (sum(x[4] or 0 for x in upto if x[1] == day), sum(x[4] or 0 for x in upto))


@pytest.mark.parametrize("most", [q.MOST_GRAMS, 0])
def test_packed_logarithms(spark, most):
    texts = ["abcab", "", "é月台", "a" * 50, "abcab", "\U0001f600x"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    grams = sorted({p[i : i + 4] for t in texts for p in ["^^^" + t + "$"] for i in range(len(p) - 3)})
    logs = spark.createDataFrame([(g, -1.0 - i / 8) for i, g in enumerate(grams)], "g4 string, lp double")
    got = {r.id: (r.log10_prob, r.n) for r in q.summed(d.repartition(2), ["id"], "t", logs, most).collect()}
    value = {g: -1.0 - i / 8 for i, g in enumerate(grams)}
    assert got == {i: (sum(value[("^^^" + t + "$")[k : k + 4]] for k in range(len(t) + 1)), len(t) + 1) for i, t in enumerate(texts)}


def test_grams_are_counted_by_batches(spark):
    said = ["ab", "", "abab ab", "ñandú 𝒳𝒳𝒳𝒳𝒳", "ab", None]
    d = spark.createDataFrame([(t,) for t in said], "t string").coalesce(1)
    want = Counter(p[i : i + 4] for p in (f"^^^{t}$" for t in said if t is not None) for i in range(len(p) - 3))
    assert {r.g4: r.c for r in q.gram_counts(d, "t").collect()} == want
    assert {r.g4: r.c for r in q.gram_counts(d.where("t not like 'ñ%'"), "t").collect()} == {g: n for g, n in want.items() if not set(g) & set("ñúd𝒳")}


@pytest.mark.parametrize("most", [q.MOST_GRAMS, 0])
def test_two_columns_are_summed_at_once(spark, most):
    d = spark.createDataFrame([(1, "abc", "ab 𝒳"), (2, "", "abc"), (3, "b", "")], "id long, x string, y string")
    of = lambda t: [f"^^^{t}$"[i : i + 4] for i in range(len(t) + 1)]
    grams = sorted({g for r in d.collect() for t in r[1:] for g in of(t)})
    worth = {g: -1.0 - i for i, g in enumerate(grams)}
    got = {r.id: tuple(r[1:]) for r in q.sums(d, ["id"], ["x", "y"], spark.createDataFrame(list(worth.items()), "g4 string, lp double"), most).collect()}
    assert got == {r.id: tuple(v for t in r[1:] for v in (sum(worth[g] for g in of(t)), len(t) + 1)) for r in d.collect()}


def test_a_row_for_each_text_however_many_grams_there_are(spark, monkeypatch):
    d = spark.createDataFrame([("alpha", "abc", "abd"), ("alpha", "abc", "abd"), ("alpha", "", "c"), ("beta", "x 𝒳", "x")], "engine string, x string, y string")
    grams = sorted({p[i : i + 4] for r in d.collect() for p in (f"^^^{r.x}$", f"^^^{r.y}$") for i in range(len(p) - 3)})
    logs = spark.createDataFrame([(g, -0.1 * i) for i, g in enumerate(grams)], "g4 string, lp double")
    rows = [sorted(tuple(r) for r in q.sums(d, ["engine"], ["x", "y"], logs, most).collect()) for most in (1000, 7)]
    assert len(rows[0]) == 4 and rows[0] == rows[1]
    want, sums = sorted(tuple(r) for r in mining.ppl_compare(spark, SF).collect()), q.sums
    monkeypatch.setattr(q, "sums", lambda *a: sums(*a, 10_000))
    assert sorted(tuple(r) for r in mining.ppl_compare(spark, SF).collect()) == want
