"""Queries on radio speech beside their SQL, and literal cases of what they are made of."""

import json

import pytest
from pyspark.sql import functions as F
from utterlake.functions import rules, terms, text
from utterlake.operators import search
from utterlake.plans import queries
from utterlake.sources import files
from utterlake.streaming import live

def value(spark, f, given):
    return spark.createDataFrame([(given,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("R7 到 G12", "R07 到 G12"), ("R 7", "R 7"), ("r 8，g 1 5", "R08，G01 5"), ("G 洞拐 R一 九", "G07 R19"), ("g兩勾", "G29"), ("G123", "G123"), ("G 零7", "G 零7"), (None, None), ("", ""),
])
def test_station_codes(spark, given, wanted):
    assert value(spark, text.fix_station_codes, given) == wanted


def test_strict_station_codes_need_a_start(spark):
    assert value(spark, lambda c: text.fix_station_codes(c, strict=True), "over 5, g 5") == "over 5, G05"


@pytest.mark.parametrize(("given", "wanted"), [
    ("occ呼叫", {("action", "呼叫")}), ("occ, Atp", {("equipment", "OCC"), ("equipment", "ATP")}), ("moreover over", {("comm", "OVER")}),
    ("12 / 13 車 g7", {("car_number", "12/13車"), ("station_code", "G7")}), ("大安站 車站長", {("station_name", "大安站")}), ("3月台、月台門", {("platform", "3月台"), ("platform", "月台門")}),
    ("", set()), ("plain words", set()),
])
def test_key_terms(spark, given, wanted):
    assert {tuple(x) for x in value(spark, terms.key_terms, given)} == wanted


@pytest.mark.parametrize(("given", "wanted"), [("a1 b22 cab", "X1 b22 cab"), ("cabb", "cabX"), ("", ""), (None, None), ("b2a", "b2X")])
def test_outside_keeps_what_is_protected(spark, given, wanted):
    swap = lambda c: rules.replace_all(c, {"a": "X", "b": "X"}, longest_first=False)
    assert value(spark, lambda c: terms.outside(c, [r"b\d+"], ["cab", "ca"], swap), given) == wanted


def test_nothing_protected(spark):
    assert value(spark, lambda c: terms.outside(c, [], [""], F.upper), "ab") == "AB"


@pytest.mark.parametrize(("given", "wanted"), [
    ("fire，3級\nsmoke, 9\nfire,5\n# x,1\nz,4\nno level\nhigh,much\ndoor , 0", [("smoke", 5), ("fire", 3), ("door", 0)]),
    ("ab,007\r\ncd,1,2\ref,00", [("ab", 5), ("cd", 5), ("ef", 0)]), ("abcdefghijklm,1\nabcdefghijkl,99999999999", [("abcdefghijkl", 5)]), ("", []),
])
def test_keyword_lines(spark, given, wanted):
    assert [tuple(x) for x in value(spark, terms.keyword_lines, given)] == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("二十三車", "23車"), ("零五車", "05車"), ("十車 十二車", "十車 12車"), ("二五車二五車", "25車25車"), ("零零車", "零零車"), ("一百車", "一百車"), ("二五二六車", "二五二六車"),
    ("一二三二十三車", "一二" + "三二十三車"), ("零零二五車", "25車"), ("二十三站", "二十三站"), ("2526車", "25/26車"), ("", ""),
])
def test_spoken_train_numbers(spark, given, wanted):
    assert value(spark, lambda c: terms.legacy_clean(c, {}), given)["text"] == wanted


def test_legacy_clean(spark):
    got = value(spark, lambda c: terms.legacy_clean(c, {"ab": "x", "q": "qq"}), " ab  g 3 1234車 912345678901234567 ")
    assert got["text"] == "x G03 12/34車 [number?]" and got["corrections_applied"] == 1
    assert value(spark, lambda c: terms.legacy_clean(c, {}), None)["text"] == ""


def test_search_by_a_written_index(spark, tmp_path):
    rows = [(1, "The night train"), (2, "night NIGHT"), (3, "knight"), (4, "nig ght igh"), (5, ""), (6, None), (7, "ab")]
    docs = spark.createDataFrame(rows, "k long, said string")
    search.write_index(docs, "k", "said", str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    by = [[tuple(r) for r in search.phrase_search(i, docs, "k", "said", "Night").collect()] for i in (index, search.postings(docs, "k", "said"), None)]
    assert by[0] == by[1] == by[2] and [r[0] for r in by[0]] == [2, 3, 1]
    assert [r.id for r in search.phrase_search(index, docs, "k", "said", "AB").collect()] == [7]
    assert search.phrase_search(index, docs, "k", "said", "nothing here").count() == 0


def test_many_terms_are_found_as_few_are(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Über den Wolken"), (2, "台北車站"), (3, ""), (4, None), (5, "a")], "k long, said string")
    words = spark.createDataFrame([("wolk",), ("a",), ("車站",), ("über den",), ("x",), ("",), (None,)], "w string")
    few = sorted(map(tuple, search.spotted(docs, words, "k", "said", "w").collect()))
    monkeypatch.setattr(search.keywords.occurring, "__defaults__", (0,))
    assert few == sorted(map(tuple, search.spotted(docs, words, "k", "said", "w").collect())) == [(1, "wolk"), (1, "über den"), (2, "車站"), (5, "a")]


def test_coverage_says_what_is_missed(spark):
    pairs = spark.createDataFrame([(1, "x", "OCC 呼叫 G07", "occ 呼教"), (2, "x", "nothing", None)], "id long, engine string, ref string, hyp string")
    got = {r.id: r for r in search.coverage(pairs, spark.createDataFrame([("occ",), ("G07",)], "phrase string")).collect()}
    assert (got[1].ps_total, got[1].ps_hits, got[1].ki_total, got[1].ki_hits) == (2, 1, 3, 1) and got[1].ki_misses == ["G07", "呼叫"]
    assert got[1].difference == round(0.5 - 0.3333, 4) and got[2].ki_rate == 0.0


def test_covered_texts_stay_where_they_stand(spark):
    """No shuffle of texts; spellings that differ in case count each; terms come as they are written."""
    rows = [(1, "occ 呼叫 Ab-c", [("x", "OCC"), ("y", None)]), (2, None, [("x", "occ")]), (3, "AB，c 呼叫", [])]
    refs = spark.createDataFrame(rows, "id long, ref string, hyps array<struct<engine: string, hyp: string>>")
    phrases = spark.createDataFrame([("occ",), ("OCC",), ("abc",), ("呼 叫",), ("É",), (None,)], "phrase string")
    d = search.covered(refs, phrases)
    assert sorted((r.id, r.engine, r.ps_total, r.ps_hits, r.ki_total, r.ki_hits) for r in d.collect()) == [(1, "x", 4, 2, 2, 1), (1, "y", 4, 0, 2, 0), (2, "x", 0, 0, 0, 0)]
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_what_comparing_leaves_out(spark):
    said = ["A:【n】x，，\nB: y", "【a】【b】C:d 【e", "x\n，A:b\n\nD:e\x0b\x0c\r\tf", "“q”—（w）！？；：、。\"'()-.,:;!?\u3000é", "\nA :x aA:", None]
    c = terms.comparable(F.col("s"))
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(c).collect()]
    old = r"[\s,，。.、:：;；!?！？\-—()（）\"'“”]+"
    want = spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(F.regexp_replace(F.coalesce("s", F.lit("")), rf"(?m)^(?:【[^】]*】)*[A-Z]:|【[^】]*】|{old}", ""))
    assert got == [r[0] for r in want.collect()]


def test_overlay_takes_safe_pairs(spark):
    rows = [("e", "abcd", "abd", 5), ("e", "abcd", "abc", 4), ("e", "xy", "xyz", 9), ("e", "a b c", "abc", 9), ("e", "same", "same", 9), ("e", "once", "ones", 1), (None, "abcd", "x", 9)]
    got = search.draft_overlay(spark.createDataFrame(rows, "engine string, wrong string, fixed string, n long")).collect()
    assert [(r.engine, r.candidates, json.loads(r.overlay)) for r in got] == [("e", 1, {"abcd": "abd"})]


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4, 11, 250]])
def test_ranks_by_ranges_are_ranks(spark, sizes):
    rows = [(None if g == 0 else f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    d = spark.createDataFrame(rows, "s string, i long")
    got = {(r.s, r.i): (r["rank"], r.n) for r in queries.ranked(d, ["s"], F.floor(F.col("i") / 7), ["i"]).collect()}
    assert got == {(None if g == 0 else f"s{g}", i): (i + 1, n) for g, n in enumerate(sizes) for i in range(n)}


def test_sync_rebuilds_and_logs(spark, tmp_path):
    (tmp_path / "h.csv").write_text("timestamp,timestamp_unix,engine_label,sample_count,avg_cer_raw\n20240101_000000,1704067200000,e,63,0.5\nx,y,f,many,\n")
    (tmp_path / "e.csv").write_text("timestamp,event_type,count,avg_cer_raw\n20240101_000000,t,7,bad\n")
    for _ in range(2):
        files.full_refresh_sync(spark, str(tmp_path / "h.csv"), str(tmp_path / "e.csv"), str(tmp_path / "out"))
    h = {r.engine_label: r for r in spark.read.parquet(str(tmp_path / "out" / "cer_history")).collect()}
    assert (h["e"].sample_count, h["e"].timestamp_unix, h["f"].sample_count, h["f"].timestamp_unix, h["f"].source_json) == (63, 1704067200000, None, None, None)
    e = spark.read.parquet(str(tmp_path / "out" / "cer_event_type_history")).first()
    assert (e.sample_count, e.avg_cer_raw) == (7, None)
    assert [(r.history_rows, r.event_rows) for r in spark.read.parquet(str(tmp_path / "out" / "cer_sync_log")).collect()] == [(2, 1), (2, 1)]


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "text": "g 7 thea"}\n')
    s = live.watched(spark, str(tmp_path / "in"), "id long, text string")
    w = live.folder_stream(s, "text", lambda c: rules.replace_all(text.fix_station_codes(c), {"thea": "the a"}), str(tmp_path / "out"), str(tmp_path / "seen"))
    for more in (None, '{"id": 2, "text": "x"}\n'):
        if more:
            (tmp_path / "in" / "b.json").write_text(more)
        w.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.id, r.final) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "G07 the a"), (2, "x")]


@pytest.mark.parametrize(("samples", "wanted"), [
    ([1.0, 1.0, 0.0, 0.0, 1.0], 0.5), ([1.0, 1.0], 1.0), ([0.0, 0.0, 1.0], 0.0), ([1.0], 1.0), ([0.0], 0.0), ([], 1.0), (None, 1.0), ([None, None, 1.0, 1.0], 0.5), ([1.0] * 100_001, 1.0),
])
def test_window_share(spark, samples, wanted):
    loud = lambda w: F.size(F.filter(w, lambda x: x > 0.5)) * 2 > F.size(w)
    d = spark.createDataFrame([(samples,)], "s array<double>")
    assert d.select(text.window_share(F.col("s"), 2, loud)).first()[0] == wanted
