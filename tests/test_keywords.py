"""The keyword automaton, and functions that must stay linear."""

import random
import time

import pytest
from pyspark.sql import functions as F
from utterlake.functions import terms, text
from utterlake.operators import keywords, search


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdé月") for _ in range(r.randint(1, n)))
    docs = [(i, " ".join(word(5) for _ in range(r.randint(0, 40))).upper() if i % 3 else word(200)) for i in range(300)] + [(900, None), (901, ""), (5, "abc")]
    words = sorted({word(6) for _ in range(400)} | {"É", "", "月"}) + [None, "A", "a"]
    return docs, words, spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(w,) for w in words], "term string")


@pytest.mark.parametrize("most", [keywords.MOST_BYTES, 0])
def test_as_brute_force(made, most):
    docs, words, d, t = made
    known = {w.lower() for w in words if w}
    want = sorted((i, w) for i, x in docs for w in known if x and w in x.lower())
    assert sorted(map(tuple, keywords.occurring(d.repartition(3), ["id"], "text", t, "term", most).collect())) == want


@pytest.mark.parametrize("most", [keywords.MOST_BYTES, 0])
def test_noted_as_brute_force(made, most):
    docs, words, d, t = made
    known = {w for w in words if w}
    want = sorted((i, x or "", sorted(w for w in known if x and w.lower() in x.lower())) for i, x in docs)
    got = keywords.noted(d.repartition(3), ["id", "text"], "text", t, "term", "found", most)
    assert sorted((r.id, r.text or "", sorted(r.found)) for r in got.collect()) == want
    assert most == 0 or "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.found) for r in keywords.noted(d, ["id"], "text", t.limit(0), "term", "found", most).collect()} == {()}


def test_no_nested_loop_and_many_terms(spark, made):
    _, _, d, _ = made
    many = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    hits = search.spotted(d.union(spark.createDataFrame([(77, "xw4999w17")], "id long, text string")), many, "id", "text", "term")
    began = time.time()
    assert {r["term"] for r in hits.where("id = 77").collect()} == {"w4", "w49", "w499", "w4999", "w1", "w17"}
    assert time.time() - began < 20
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()


def test_no_terms(made):
    _, _, d, t = made
    assert search.spotted(d, t.where("term is null"), "id", "text", "term").count() == 0


def test_keyword_lines_of_a_long_reply(spark):
    lines = "\n".join(f"key{i % 3000},{i % 7}" for i in range(4000))
    d = spark.createDataFrame([(lines,)], "c string").select(terms.keyword_lines(F.col("c")).alias("k"))
    d.collect()
    began = time.time()
    got = [tuple(x) for x in d.first()["k"]]
    assert time.time() - began < 2 and len(got) == 3000
    assert got == [(f"key{i}", min(5, i % 7)) for i in sorted(range(3000), key=lambda i: (-min(5, i % 7), i))]


def plain_cut(x, least=2, most=30, times=5):
    for k in range(least, most + 1):
        unit = x[-k:]
        if len(x) >= k * times and x.endswith(unit * times):
            n = times
            while x.endswith(unit * (n + 1)) and len(x) >= k * (n + 1):
                n += 1
            return x[: len(x) - k * (n - 1)].rstrip(" ")
    return x


def test_truncate_repetition(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 12))) + "".join(r.choice("ab 月") for _ in range(r.randint(1, 33))) * r.randint(1, 9) for _ in range(500)]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "c string").select(text.truncate_repetition(F.col("c"))).collect()]
    assert got == [plain_cut(t) for t in texts]


def test_truncate_repetition_of_a_megabyte(spark):
    d = spark.createDataFrame([("x" + "ab" * 500_000,), ("y" * 1_000_000 + "z",), (None,)], "c string").select(text.truncate_repetition(F.col("c")).alias("v"))
    d.collect()
    began = time.time()
    assert [r["v"] for r in d.collect()] == ["xab", "y" * 1_000_000 + "z", None] and time.time() - began < 3
