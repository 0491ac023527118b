"""N-gram Jaccard join and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from utterlake.llm import jaccard_join, substring_dedup
from utterlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def made(spark):
    """Near copies in chains and stars, exact copies, shared passages, short and empty texts."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []

    def edited(w, k):
        w = list(w)
        for i in r.sample(range(len(w)), k):
            w[i] = r.choice(vocabulary)
        return w

    for _ in range(12):
        base = text(r.choice([40, 120, 300]))
        rows.append(base)
        for _ in range(r.choice([1, 3, 12])):
            rows.append(edited(base, r.randint(0, max(1, len(base) // 40))))
        chain = base
        for _ in range(5):
            chain = edited(chain, max(1, len(base) // 60))
            rows.append(chain)
    for _ in range(60):
        cut = r.randint(0, 100)
        rows.append(text(cut) + passage[: r.choice([34, 35, 36, 50, 60])] + text(r.randint(0, 40)))
    rows += [passage] * 5 + [["a"], ["a"], ["A"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "D"], ["x"] * 200, ["x"] * 300, passage + passage]
    rows += [text(6000)] + [text(90) for _ in range(40)]
    data = [(i, " ".join(w) if i % 3 else "\n".join(w), 1, "x") for i, w in enumerate(rows)]
    data += [(9001, None, 1, "x"), (9002, "", 1, "x"), (9003, " \t\n", 1, "x"), data[3], data[70]]
    r.shuffle(data)
    return spark.createDataFrame(data, "doc_id long, text string, key int, k string")


def brute_components(rows):
    def shingles(t):
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    seen = set()
    for m in by.values():
        for a in range(len(m)):
            for b in range(a):
                seen.add((m[b], m[a]))
    for a, b in seen:
        o = len(s[a] & s[b])
        if 100 * o >= 75 * (len(s[a]) + len(s[b]) - o):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s[i]), low[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("table", ["made", "sf"])
def test_jaccard_join(spark, sf_dir, made, table):
    d = made if table == "made" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute_components(d.collect())
    assert Counter(map(tuple, jaccard_join.classes(d).collect())) == expected
    if table == "made":
        kept = jaccard_join.first_of_each(d)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({k[2] for k in expected})


def test_first_of_each_with_repeated_ids(spark):
    """Near copies under one id, repeated rows, wordless rows and a null id: one row of each component stays."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, b), (5, a), (5, a + " more"), (5, b + " more"), (7, "lone text of six words here"), (7, "lone text of six words here"), (7, None), (7, None), (8, ""), (8, " "), (None, "n1 n2 n3"), (9, "n1 n2 n3")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = Counter((r.doc_id, r.text) for r in jaccard_join.first_of_each(d).collect())
    first = [t for t in (a, a + " more") if (5, t) in got]
    assert len(first) == 1
    assert got == Counter([(3, b), (5, first[0]), (7, "lone text of six words here"), (7, None), (7, None), (8, ""), (8, " "), (None, "n1 n2 n3")])
    assert jaccard_join.first_of_each(d.limit(0)).collect() == []


def test_jaccard_join_of_frequent_grams(spark, monkeypatch):
    """With the least block, the nodes of every shared n-gram are dealt to several keys."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 0)
    r = random.Random(11)
    tail = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(90):
        w = list(tail)
        for j in r.sample(range(40), r.randint(0, 3)):
            w[j] = f"n{r.randint(0, 12)}"
        rows.append((i, " ".join([f"h{r.randint(0, 2)}"] * r.randint(0, 1) + w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.classes(d).collect())) == brute_components(d.collect())


def test_jaccard_join_empty(made):
    assert jaccard_join.classes(made.limit(0)).collect() == []


def test_residual_pairs(spark, monkeypatch):
    """Links that neither a hub nor a centre shows: only the last round can find them."""
    r = random.Random(8)
    for seed in range(3):
        r.seed(seed)
        base = [f"b{i}" for i in range(80)]
        rows = []
        for i in range(70):
            w = list(base)
            for j in r.sample(range(80), r.randint(0, 6)):
                w[j] = f"n{r.randint(0, 30)}"
            rows.append((i, " ".join(w[r.randint(0, 6) : 80 - r.randint(0, 6)])))
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(map(tuple, jaccard_join.classes(d).collect())) == brute_components(d.collect())


def brute_dedup(rows):
    words = [WORD.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table", ["made", "sf"])
def test_substring_dedup(spark, sf_dir, made, table):
    d = made if table == "made" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, substring_dedup.dedup(d).collect())) == brute_dedup(d.collect())


def test_substring_dedup_empty(made):
    assert substring_dedup.dedup(made.limit(0)).collect() == []


def test_fingerprint_index(made):
    texts = substring_dedup.keyed(made, "doc_id", "text")
    index = substring_dedup.FingerprintIndex(most_runs=1)
    first = texts.where("doc_id < 60")
    assert index.add(first).where("seen").count() == 0
    again = index.add(first)
    assert again.where("not seen").count() == 0 and len(index.runs) == 1
    assert index.merged().where("n < 2").count() == 0


def test_components_of_long_paths(spark):
    """Paths of more hops than there are rounds: one falling to its end, one of nodes in any order."""
    r = random.Random(2)
    falling = [0, *range(150, 0, -1)]
    mixed = r.sample(range(1000, 1400), 400)
    rows = [(a, b) for path in (falling, mixed) for a, b in zip(path, path[1:])]
    got = {x.node: x.label for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {n: min(path) for path in (falling, mixed) for n in path}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(rows, "a long, b long"), rounds=1)


def test_substring_dedup_with_older_documents(spark):
    """A window that the new documents have once and the older ones have too is a repeat; compaction runs in between."""
    r = random.Random(4)
    text = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    old = [text(r.randint(40, 90)) for _ in range(12)]
    new = [text(20) + old[i][3:39] + text(15) for i in range(6)] + [old[7], text(60), old[8][:34] + text(20), new_twice := text(50), new_twice, old[0][:36]]
    frame = lambda rows, at: spark.createDataFrame([(at + i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    before, now = frame(old, 0), frame(new, 100)
    index = substring_dedup.FingerprintIndex()
    index.add(substring_dedup.keyed(before, "doc_id", "text"))
    got = Counter(map(tuple, substring_dedup.dedup(now, index=index).collect()))
    assert index.retired and len(index.runs) < 1 + substring_dedup.BATCHES
    assert got == Counter({k: n for k, n in brute_dedup(before.collect() + now.collect()).items() if k[0] >= 100})
