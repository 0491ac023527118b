"""Literal cases of records, manifests, prices and cleaned scripts."""

import pytest
from pyspark.sql import functions as F
from utterlake.functions import text
from utterlake.operators import records
from utterlake.sources import files


def value(spark, f, given):
    return spark.createDataFrame([(given,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("第 1 章節：開場\n第2章節", ""), ("0:044 秒好的\n1:131 分鐘 13 秒 收到", "好的\n收到"), ("Delta呼叫Charlie 請回報", "請回報"), ("這裡是Charlie收到", "收到"),
    ("太陽花（學運）開始（一二三四五六）", "太陽花開始（一二三四五六）"), ("a (x) b", "a  b"), ("## title\n\n at 10:20 go\r\nend", "at  go\nend"), ("hello world", "hello world"), ("", ""), (None, None),
])
def test_clean_reference_script(spark, given, wanted):
    assert value(spark, text.clean_reference_script, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("A: 好的，ok\nB: x\n\n noise", (10, 2)), ("?: a", (1, 1)), ("", (0, 0)), (None, (0, 0)), ("AB: no", (4, 0))])
def test_reference_size(spark, given, wanted):
    assert tuple(value(spark, records.reference_size, given)) == wanted


def test_like_pattern(spark):
    rows = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("axb",), ("c\\d",)], "c string")
    hits = lambda w: [r.c for r in rows.where(F.col("c").like(text.like_pattern(w))).collect()]
    assert hits("%") == ["50% off"] and hits("a_b") == ["a_b"] and hits("\\") == ["c\\d"] and len(hits("")) == 5


def test_dominant(spark):
    d = spark.createDataFrame([(["SAD", "HAPPY"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(text.dominant(F.col("t"), ["HAPPY", "SAD"])).collect()] == ["SAD", None, None]


def test_prices_fall_back(spark):
    calls = spark.createDataFrame([("a", 1_000_000, 0), ("b", 0, 1_000_000), ("large", 2_000_000, 0), (None, 1_000_000, 1_000_000)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("a", 2.0, 3.0), ("b", None, 9.0)], "model string, usd_in double, usd_out double")
    got = [tuple(r) for r in records.token_cost(calls, prices, {"small": (0.3, 2.5), "large": (1.25, 10.0)}, "small", 31.0).select("model", "usd", "local", "fallback").collect()]
    assert sorted(got, key=str) == sorted([("a", 2.0, 62.0, False), ("b", 2.5, 77.5, True), ("large", 2.5, 77.5, True), (None, 2.8, 86.8, True)], key=str)


def test_deleted_parents(spark):
    parents = spark.createDataFrame([(1,), (1,)], "p int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, p_id int")
    assert {r.c for r in records.cascade(children, parents, "p_id", "p").collect()} == {11, 12}
    assert {tuple(r) for r in records.set_null(children, parents, "p_id", "p").collect()} == {(10, None), (11, 2), (12, None)}


def test_byte_order_mark(spark, tmp_path):
    files.write_csv_sorted(spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int"), str(tmp_path / "o"), ["k"], mark=True)
    raw = sorted(p.read_bytes() for p in (tmp_path / "o").glob("*.csv"))
    assert all(r.startswith(b"\xef\xbb\xbfk,n") for r in raw) and spark.read.csv(str(tmp_path / "o"), header=True).count() == 2


def test_two_engines_are_compared_without_the_store(spark, monkeypatch):
    from utterlake.operators import scores
    from utterlake.plans import records as plans

    monkeypatch.setattr(scores, "extend", lambda *a: 1 / 0)
    plan = plans.ensemble_bound(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # the rates of a segment
