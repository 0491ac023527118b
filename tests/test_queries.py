"""Registered queries against their SQL, and literal cases of the column functions."""

import duckdb
import pytest
from pyspark.sql import functions as F
from utterlake.functions import metrics, rules, text

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
#: Their terms don't occur in the smallest tables.
MAY_BE_EMPTY = {"orphan_check", "like_search", "safe_pair", "partial_supersede", "vocab_filter", "since_id_delta"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


#: Every registered query with SQL, so none can go untested; those of the optional subpackage only where it is there.
ORACLE, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, duck, name):
    said = compare(spark, duck, SF, QUERIES[name], ORACLE[name])
    assert said == "" or (said == "no rows" and name in MAY_BE_EMPTY), said


def value(spark, f, *given):
    df = spark.createDataFrame([given], ", ".join(f"c{i} string" for i in range(len(given))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "given", "wanted"), [
    (text.normalize_eval, "[7:05:59]列車 [x] 進站", "列車x進站"), (text.normalize_eval, "Ｚ９-ｂ!", "z9b"), (text.normalize_eval, "R22...OK？", "r22ok"),
    (text.normalize_cer, "A: hello, [noise] there\nB: x。", "hellotherex"), (text.full_to_half, "（Ａ　１）", "(A 1)"), (text.strip_meta, "a (laughter)b[Noise]（silence 3.5s）", "a b"),
    (text.fix_number_explosion, "x 123456789012345678 y", "x 12 y"), (text.fix_number_explosion, "912345678901234567", "[number?]"),
    (text.truncate_repetition, "so " + "abc " * 7, "so abc"), (text.truncate_repetition, "abcabc", "abcabc"), (text.fix_station_codes, "G 0 7 and g7", "G07 and G07"),
    (text.safe_name, ' a/b: c?  d ', "ab_c_d"), (text.safe_name, "??", "untitled"), (text.parse_numeral, "二十三", 23), (text.parse_numeral, "十", 10), (text.parse_numeral, "042", 42), (text.parse_numeral, "x", None),
    (text.strip_live_lines, "INFO x\n[10:20:30] a\n[10:20:31] b", "a b"),
])
def test_text(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("第一句。第二句！x", ["第一句", "第二句"]), ("we go over then wait", ["we go over", "then wait"]), ("moreover it rains", ["moreover it rains"]),
    ("知道收到 G05 呼叫行控", ["知道收到", "G05 呼叫行控"]), ("【10:00】 hello\nworld", ["hello", "world"]), ("a" * 95, ["a" * 40, "a" * 40, "a" * 15]),
    ("word " * 12, ["word word word word word word word word", "word word word word"]), ("", []), (None, None), ("a", []),
])
def test_split_sentences(spark, given, wanted):
    assert value(spark, text.split_sentences, given) == wanted


def test_distance(spark):
    rows = [("", ""), ("a", ""), ("kitten", "sitting"), ("x" * 30, "y" * 30), ("same", "same"), ("abcdefghijklmnopq", "abcdefghijklmnop"), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(metrics.distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("e")).collect()
    assert all(r.d == r.e for r in got)


def test_file_names(spark):
    assert str(value(spark, text.filename_datetime, "rec_20240131_101112.wav")) == "2024-01-31 10:11:12"
    assert value(spark, text.filename_datetime, "20241331101112") is None


@pytest.mark.parametrize(("ref", "hyp", "plain", "spaced"), [("abc", "abd", 0.333333, 0.333333), ("ab", "abc", 0.5, 1.0), ("", "x", 0.0, 0.0), ("台門é", "月門e", 0.666667, 0.666667)])
def test_cer(spark, ref, hyp, plain, spaced):
    assert value(spark, metrics.cer, ref, hyp) == plain
    assert value(spark, lambda a, b: metrics.cer(a, b, spaced=True), ref, hyp) == spaced


def test_wer(spark):
    assert value(spark, metrics.wer, "the cat sat", "the bat sat down") == 0.666667
    assert value(spark, metrics.wer, "", "x") == 0.0


def test_rules(spark):
    table = {"ab": "x", "abc": "y"}
    assert value(spark, lambda c: rules.replace_all(c, table), "abc ab") == "y x"
    log = value(spark, lambda c: rules.replace_log(c, table, "s"), "abc ab ab")
    assert [(r["from"], r["count"]) for r in log] == [("abc", 1), ("ab", 2)]
    rule = [rules.Contextual("red ", "lite", " on", "light", 2), rules.Contextual("", "x", "", "x")]
    assert value(spark, lambda c: rules.contextual(c, rule), "red a lite on, a lite meal") == "red a light on, a lite meal"


@pytest.mark.parametrize("note", ["(沉默 3 秒)", "(沉默十秒)", "(沉默 5s)", "(silence3)", "(silence 3s)", "(笑聲)", "(咳嗽)", "(雜音)", "(noise)", "(laughter)", "(cough)", "(unclear)", "(inaudible)", "[noise]", "[unclear]", "（沉默一下）"])
def test_strip_meta_has_the_reference_notes(spark, note):
    assert spark.createDataFrame([(f"a{note}b (kept)",)], "x string").select(text.strip_meta(F.col("x"))).first()[0] == "ab (kept)"


@pytest.mark.parametrize("nulls", [(), ("orders",), ("lineitem",), ("empty",)])
def test_orphans_as_not_in_says(spark, tmp_path, nulls):
    o, l = [1, 2, 2, 5] + [None] * ("orders" in nulls or "empty" in nulls), [] if "empty" in nulls else [1, 1, 7, 7] + [None] * ("lineitem" in nulls)
    con = duckdb.connect()
    for name, key, rows in (("orders", "o_orderkey", o), ("lineitem", "l_orderkey", l)):
        spark.createDataFrame([(x,) for x in rows], f"{key} long").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), QUERIES["orphan_check"], ORACLE["orphan_check"]) == ""
