"""Correction chains, overlays by engine, fusion with a spare engine, edit distances and dealing of small tables."""

import random

from pyspark.sql import functions as F

from utterlake.functions import metrics, rules
from utterlake.operators import alignment
from utterlake.plans import adapters

TERMS, WORDS = {"abc": "xyz"}, {"old": "new"}
AROUND = [rules.Contextual("in ", "sit", "", "sat", 1)]


def chain(spark, texts, off=()):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.asDict() for r in rules.post_process(d, "t", TERMS, WORDS, AROUND, off).collect()]


def test_post_process_takes_stages_in_order_and_counts(spark):
    (r,) = chain(spark, ["abc abc 12/3車 old in sit 五月台"])
    assert r["after_terms"] == "xyz xyz 12/3車 old in sit 五月台"
    assert r["after_car"] == "xyz xyz 12/03 車 old in sit 五月台"
    assert r["after_number"] == "xyz xyz 12/03 車 old in sit 5 月台"
    assert r["after_dict"] == "xyz xyz 12/03 車 new in sit 5 月台"
    assert r["final"] == r["after_context"] == "xyz xyz 12/03 車 new in sat 5 月台"
    assert r["changes"] == {"terms": 2, "car": 1, "number": 1, "dict": 1, "context": 1}


def test_post_process_switches_null_and_empty(spark):
    off, null, empty = chain(spark, ["abc old 12/3車", None, ""], rules.STAGES)
    assert off["final"] == "abc old 12/3車" and null["final"] is None and empty["final"] == ""
    assert all(set(r["changes"].values()) == {0} for r in (off, null, empty))
    some = chain(spark, ["abc old"], ("terms",))[0]
    assert some["final"] == "abc new" and some["changes"]["terms"] == 0 and some["changes"]["dict"] == 1
    assert chain(spark, [None])[0]["changes"] == dict.fromkeys(rules.STAGES, 0)


def test_overlays_add_replace_and_remove(spark):
    d = spark.createDataFrame([("p", "abc d"), ("r", "abc d"), (None, "abc d"), ("p", None)], "e string, t string")
    fixed = rules.by_engine(F.col("e"), F.col("t"), TERMS, {"p": {"abc": "q", "d": "dd"}, "r": {"abc": None}})
    assert [r[0] for r in d.select(fixed).collect()] == ["q dd", "abc d", "xyz d", None]


def test_fusion_with_a_spare_engine(spark):
    cases = [
        ("aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab", "s", "R1", "a"), ("aaaaaaaaaa", "aaaaaaaabb", "s", "R2", "b"), ("aaaa", "bbbb", None, "R3", "a"),
        ("aa", " ", "s", "R4", "a"), (None, "bb", "s", "R5", "b"), ("", None, " s ", "R6", "spare"), (None, "", None, "R7", ""),
    ]
    d = spark.createDataFrame([c[:3] for c in cases], "a string, b string, c string")
    got = [r[0] for r in d.select(alignment.fuse_whole(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert [(r["rule"], r["source"]) for r in got] == [c[3:] for c in cases]
    assert [r["fused"] for r in got] == [cases[0][0], cases[1][1], "aaaa", "aa", "bb", "s", ""]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_edit_distances_by_brute_force(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("ab ") for _ in range(r.randrange(30))), "".join(r.choice("ab ") for _ in range(r.randrange(30)))) for _ in range(150)]
    pairs += [("w " * 900, "w " * 890), (" ".join(map(str, range(60))), " ".join(map(str, range(5, 60))))]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", metrics.distance("a", "b").alias("d"), metrics.wer(F.col("a"), F.col("b")).alias("w"))
    for a, b, n, w in d.collect():
        if len(a) < 1000:
            assert n == plain_distance(a, b)
            x, y = a.split(), b.split()
            assert w == (round(plain_distance(x, y) / len(x), 6) if x else 0)
        else:
            assert (n, w) == (20, round(10 / 900, 6))


def test_words_past_the_surrogates_count_as_words(spark):
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")).alias("w"))
    s = d.select(F.array_join(F.slice("w", 1, 55_500), " ").alias("s"))
    words = d.select(metrics.word_chars(F.slice("w", 55_290, 20), F.slice("w", 1, 55_400)).alias("c")).first()[0]
    assert len(words) == len(set(words)) == 20 and not any(0xD800 <= ord(x) < 0xE000 for x in words) and s.count() == 1


def test_small_tables_are_dealt_and_keep_pruning(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text", "'s' as source").coalesce(1).write.parquet(path)
    d = adapters.texts(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.count() == 1000
    plan = d.where("doc_id > 5").select("text")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "source" not in plan
    many = str(tmp_path / "many.parquet")
    spark.range(1000).repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(many)
    assert "RoundRobin" not in adapters.spread(spark.read.parquet(many))._jdf.queryExecution().executedPlan().toString()
