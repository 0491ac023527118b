"""Literal cases of the number rules."""

import time

import pytest
from pyspark.sql import functions as F
from utterlake.functions import numbers

SAME = None
NUMBERS = {
    "晚上八點二十分發車": "20:20 發車", "凌晨零點五分": "00:05", "傍晚六點整": "18:00", "十六時": "16:00", "下午 3 點 05 分": "15:05", "夜間十一點半": "23:30", "中午十二點半": "12:30",
    "廿時": SAME, "二十五時十分": "二十五時 10 分", "三點七十分": "三點 70 分", "一二三點": SAME, "洞八時三洞分": "08:30", "八點鐘到": "08:00 到",
    "r3 通告": "R03 通告", "G9": "G09", "xG9": SAME, "G9a": SAME, "R15 列車": SAME, "往g2站": "往G02 站",
    "十二月台": "12 月台", "3 月台": SAME, "一二三月台": SAME, "七公里": "7 公里", "兩小時": "2 小時", "零秒": SAME, "四十五秒後": "45 秒後", "停 30秒": "停 30 秒",
    "請R6 站長於上午七點十分前到四月台等兩分鐘": "請R06 站長於 07:10 前到 4 月台等 2 分鐘", "沒有數字": SAME, "": SAME, "a  b": "a b",
}
CARS = {"1112車門": "11/12 車門", "7/12 車": "07/12 車", "一三一四動車": "13/14 動車", "腰拐車": "17 車", "8車門": "8 車門", "34車站": SAME, "1 ／ 2車": "01/02 車", "123車": SAME, "12345車": SAME, "車": SAME, "": SAME}


@pytest.mark.parametrize(("f", "cases"), [(numbers.normalize_numbers, NUMBERS), (numbers.normalize_car_numbers, CARS)])
def test_cases(spark, f, cases):
    got = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", f(F.col("t")).alias("o")).collect()
    wanted = {k: k if v is SAME else v for k, v in cases.items()} | {None: None}
    assert {r["t"]: r["o"] for r in got if r["o"] != wanted[r["t"]]} == {}


def test_spellings():
    table = numbers.spellings()
    assert set(table.values()) == set(range(100))
    assert [table[x] for x in ("0", "十", "2十", "3十7", "99", "07", "7", "1十", "2十2")] == [0, 10, 20, 37, 99, 7, 7, 10, 22]
    assert not {"", "十十", "123", "2十00", "0十"} & set(table)


def test_changes_are_counted_one_by_one(spark):
    rows = [("下午兩點半到 g7，三月台、5 月台、四月台", "1234車 25 / 26 車 25/26 車"), ("nothing", ""), (None, None)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in d.select(numbers.number_changes(F.col("a")), numbers.car_number_changes(F.col("b"))).collect()]
    assert got[:2] == [(4, 2), (0, 0)] and all(x is None or x <= 0 for x in got[2])


def test_patterns_are_tried_only_where_their_words_are(spark):
    long = "in 1998 the 24 trains of line g ran 365 days, 7:30 to 23:15 " * 20_000
    d = spark.createDataFrame([(1, long), (2, "下午三點半"), (3, None)], "id long, t string").coalesce(1)
    began = time.time()
    got = {r.id: r.out for r in d.select("id", numbers.normalize_numbers(F.col("t")).alias("out")).collect()}
    assert got == {1: long, 2: "15:30", 3: None} and time.time() - began < 20
    kept = d.where("id = 2").select(numbers.rewrite(F.col("t"), "三", lambda g: F.lit("3"), words="月台|米").alias("out")).first().out
    assert kept == "下午三點半"
