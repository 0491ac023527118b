"""Whitening, vector codes and URL filters against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from utterlake.llm import url_filter, vector_codes, whitening

KINDS = "vec_id long, embedding array<float>, label int, n int, y string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], KINDS)


@pytest.fixture(scope="module")
def made():
    r = random.Random(3)
    hot = [r.gauss(0, 0.3) for _ in range(12)]
    rows = [(i, [r.gauss(0, 0.1 * (j + 1)) for j in range(12)], r.choice([0, 1, 2, None])) for i in range(700)]
    rows += [(1000 + i, hot, 1) for i in range(300)] + [rows[5], rows[5], (None, rows[7][1], None)]
    bad = [(2000, None, 1), (2001, [0.1] * 11 + [None], 1), (2002, [float("nan")] * 12, 1), (2003, [0.1] * 11 + [float("inf")], 1), (2004, [], 1), (2005, [0.5] * 5, 1), (2006, [1e30] * 12, 1)]
    rows += bad
    r.shuffle(rows)
    return rows, [x for x in rows if x[0] is None or x[0] < 2000]


def f32(v):
    return [float(np.float32(c)) for c in v]


# ---- whitening


def test_cross_products_are_exact():
    r = np.random.default_rng(1)
    for n, low, high in ((1, 0, 1), (63, -5, 5), (64, -40, 40), (65, 10**6, 10**6 + 3), (1000, -(2**40), 2**40), (200, -(2**54), 2**54)):
        x = r.integers(low, high, (n, 5))
        x[:, 2] = low
        s, p = whitening.cross_products(x)
        o = x.astype(object)
        assert list(s) == list(o.sum(axis=0)) and (p == o.T @ o).all()


def test_whitening(spark, made):
    rows, good = made
    got = whitening.long_form(whitening.whiten(vectors(spark, rows).repartition(3))).collect()
    x = [[math.floor(64 * c) + 10**6 for c in f32(v)] for _, v, _ in good]
    n, d = len(x), 12
    total = [sum(v[a] for v in x) for a in range(d)]
    exact = [[Fraction(sum(n * v[a] * v[b] for v in x) - total[a] * total[b], n * n) for b in range(d)] for a in range(d)]
    e, _ = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
    e = e[::-1]
    assert len(got) == n * 12 and {r.component for r in got} == set(range(1, 13)) and {r.n for r in got} == {n}
    by_id, wanted = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    for (i, _, _), v in zip(good, x):
        wanted[i].append(sum((n * a - s) ** 2 for a, s in zip(v, total)))
    for i, want in wanted.items():
        assert sorted(r.deviation for r in by_id[i] if r.component == 1) == sorted(want)
    explained = {(r.component, r.explained) for r in got}
    assert len(explained) == 12 and all(abs(v - e[k - 1] / e.sum()) < 1e-9 for k, v in explained)
    y = np.array([[r.whitened for r in sorted(by_id[i], key=lambda r: r.component)] for i in by_id if len(by_id[i]) == 12])
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # as measured on the returned rows of every vector, in whatever order
    m = defaultdict(list)
    for r in got:
        m[r.component].append((r.deviation, r.whitened))
    assert all(abs(sum(w for _, w in v)) < 1e-6 and abs(sum(w * w for _, w in v) / n - 1) < 1e-9 for v in m.values())
    centred = y - y.mean(axis=0)
    assert np.abs(np.cov(centred.T, bias=True) - np.eye(12)).max() < 0.1


def test_whitening_covariance_of_returned_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=6) @ r.normal(size=(6, 6))).tolist(), 0) for i in range(400)]
    y = np.array([x.y for x in whitening.whiten(vectors(spark, rows)).collect()])
    assert np.abs(y.T @ y / len(y) - np.eye(6)).max() < 1e-9


def test_whitening_edges(spark):
    assert whitening.long_form(whitening.whiten(vectors(spark, []))).collect() == []
    assert whitening.long_form(whitening.whiten(vectors(spark, [(1, None, 1)]))).collect() == []
    assert [tuple(r.y) for r in whitening.whiten(vectors(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)])).collect()] == [(), ()]
    line = whitening.long_form(whitening.whiten(vectors(spark, [(i, [i / 8, -i / 8, 3.0], 1) for i in range(9)]))).collect()
    assert {r.component for r in line} == {1} and {r.explained for r in line} == {1.0}
    huge = whitening.whiten(vectors(spark, [(i, [float(2**40 * i), 1.0], 1) for i in range(4)])).collect()
    x = [2**46 * i for i in range(4)]
    assert sorted(int(r.deviation) for r in huge) == sorted((4 * v - sum(x)) ** 2 for v in x)


# ---- vector codes


def plain_codes(good, parts=4, entries=256, rounds=4):
    x = [(i is None, i or 0, [math.floor(1024 * c) for c in f32(v)], lab) for i, v, lab in good]
    w = 12 // parts
    first = sorted((a, b, v) for a, b, v, _ in x)[:entries]
    books = [[v[p * w : (p + 1) * w] for _, _, v in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(books[p]))

    for turn in range(rounds + 1):
        at = [[nearest(p, v[p * w : (p + 1) * w]) for p in range(parts)] for _, _, v, _ in x]
        if turn == rounds:
            break
        for p in range(parts):
            groups = defaultdict(list)
            for (_, _, v, _), a in zip(x, at):
                groups[a[p][1]].append(v[p * w : (p + 1) * w])
            for k, vs in groups.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    per = Counter()
    for (_, _, _, lab), a in zip(x, at):
        per[lab] += sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), per[lab], sha) for (i, _, lab), a in zip(good, at))


def test_codes(spark, made):
    rows, good = made
    wanted = plain_codes(good)
    for parts in (1, 5):
        got = vector_codes.coded(vectors(spark, rows).repartition(parts))
        assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == wanted


def test_bounds_skip_but_never_change_a_result():
    r = np.random.default_rng(4)
    x = r.integers(-300, 300, (2000, 4))
    x[:400] = x[0]
    history, code, b, skipped = [x[500:580].copy()], None, None, 0
    for turn in range(6):
        full = vector_codes.squared(x, history[-1])
        code, best, b, done = vector_codes.assign(x, history, code, b)
        assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
        low = np.array([full[:, g * 16 : (g + 1) * 16].min(axis=1) for g in range(5)]).T
        now = vector_codes.displaced(history, 5)
        assert (b.low - now[b.stamp, np.arange(5)] <= np.sqrt(low) + 1e-6).all() and (b.stamp <= turn).all()
        skipped += full.size - done
        book = history[-1].copy()
        for k in range(len(book)):
            if (code == k).any():
                book[k] = x[code == k].sum(axis=0) // (code == k).sum()
        history.append(book)
    assert skipped > 0


def test_net_displacement_is_at_most_the_sum_of_steps():
    a, b = np.array([[0, 0]] * 16), np.array([[30, 40]] * 16)
    assert vector_codes.displaced([a, b, a], 1)[:, 0].tolist() == [0.0, 50.0, 0.0]


def test_large_components_are_exact():
    x = np.array([[2**60, 1], [2**60, 3], [-(2**60), 0]])
    code, best, _, _ = vector_codes.assign(x, [np.array([[2**60, 2], [0, 0]])], None, None)
    assert code.tolist() == [0, 0, 1] and [int(v) for v in best] == [1, 1, 2**120]


def test_codes_edges(spark):
    assert vector_codes.coded(vectors(spark, [])).collect() == []
    few = vector_codes.coded(vectors(spark, [(2, [1.0, 2.0, 3.0, 4.0, 5.0], None), (1, [0.0] * 5, 7), (1, [0.0] * 5, None)])).collect()
    assert sorted((r.vec_id, r.error, r.label_error) for r in few) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert {r.code for r in few if r.vec_id == 1} == {"00000000"} and {r.code for r in few if r.vec_id == 2} == {"02020200"}  # the last part lies beyond the vector


# ---- url filters


def plain_verdicts(pages, rules=url_filter.RULES):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        return "".join(c.lower() if c.isascii() else c for c in m[0]), re.match(r"[^?#]*", rest[m.end() :])[0]

    def fits(h, p):
        found = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return min(found, key=lambda r: (-len(r.text), r.text), default=None)

    seen = [(i, *parts(u), html) for i, u, html in pages]
    given = [fits(h, p) for _, h, p, _ in seen]
    n, t0, d0, edges = Counter(h for _, h, _, _ in seen if h), Counter(), Counter(), Counter()
    for (_, h, _, html), r in zip(seen, given):
        if h and r:
            (t0 if r.verdict == "allow" else d0)[h] += 1
        names = {x.lower() for x in re.findall(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?", html or "")}
        edges.update((h, x) for x in names if h and x in n and x != h)
    unit = 10**12
    t0, d0 = ({h: math.floor(unit * (c[h] / n[h])) for h in n} for c in (t0, d0))
    out, into = Counter(), Counter()
    for (a, b), k in edges.items():
        out[a] += k
        into[b] += k
    t, d = dict(t0), dict(d0)
    for _ in range(url_filter.ROUNDS):
        nt, nd = ({h: math.floor(float(v) * (1 - 0.85)) for h, v in base.items()} for base in (t0, d0))
        for (a, b), k in edges.items():
            nt[b] += math.floor(float(t[a]) * 0.85 * (k / out[a]))
            nd[a] += math.floor(float(d[b]) * 0.85 * (k / into[b]))
        t, d = nt, nd
    return sorted(
        (i, h, p, r and r.text, r.verdict if r else "block" if d.get(h, 0) > 3 * t.get(h, 0) else "allow", t.get(h, 0), d.get(h, 0)) for (i, h, p, _), r in zip(seen, given)
    )


def judged(spark, pages):
    df = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, host string, trust string")
    return sorted(tuple(r) for r in url_filter.judge(df).collect())


def test_url_filter(spark):
    r = random.Random(9)
    hosts = [f"{w}.{n}" for w in ("good", "bad", "M.x", "blog.farm", "ring") for n in ("example.org", "example.com", "example.net", "other.net")] + ["example.org", "org", "notorg"]
    pages = []
    for i in range(400):
        h = r.choice([*hosts, *hosts[:3] * 6])
        html = " ".join(r.choice([f'<a href="https://{r.choice(hosts)}/x">y</a>', f"&copy; {r.choice(hosts).upper()}", "a.b.c index.html", "x" * 50, h]) for _ in range(r.randint(0, 4)))
        pages.append((i, f"{r.choice(['http', 'HTTPS', 'a b'])}://{h}{r.choice(['', '/', '/fr/1', '/de/2', '/en/1', '/en/15', '/en/2', '/es/1?q=/de/', '#/de/', '?x=http://good.example.org/fr/'])}", html))
    pages += [(900, None, "good.example.org"), (901, "no scheme/de/", None), (902, "://", ""), (903, "http://EXAMPLE.org/en/1://x", None), pages[3], pages[3], (904, "http://x.org/a\nb#c", None)]
    got = judged(spark, pages)
    assert got == plain_verdicts(pages)
    free = [g for g in got if g[3] is None and g[1]]
    assert {g[4] for g in free} == {"allow", "block"} and any(g[6] for g in free if g[1].endswith("net"))


def test_distrust_runs_against_links_and_trust_along_them(spark):
    pages = [(1, "http://spam.com/de/1", ""), (2, "http://shop.net/a", "see http://spam.com/"), (3, "http://far.net/a", "see shop.net"), (4, "http://ok.org/a", "we like nice.net"), (5, "http://nice.net/", "and spam.com")]
    said = {g[0]: g[4] for g in judged(spark, pages)}
    assert said == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_long_names_take_linear_time(spark):
    assert judged(spark, [(1, "http://a.net/", "a" * 3_000_000), (2, "http://b.net/", "a." * 500_000)])[0][4] == "allow"


def test_url_filter_edges(spark):
    assert judged(spark, []) == []
    assert judged(spark, [(1, None, None)]) == [(1, "", "", None, "allow", 0, 0)]
