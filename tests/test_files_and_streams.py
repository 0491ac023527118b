"""Files written and read again, streams from files, and alignments held against literal cases."""

import json

import pytest
from pyspark.sql import functions as F
from utterlake.functions import text
from utterlake.operators import alignment
from utterlake.sources import files
from utterlake.streaming import live


def put(folder, **contents):
    for name, body in contents.items():
        (folder / name.replace("__", ".")).write_text(body, encoding="utf-8")
    return str(folder)


def test_text_and_csv(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    put(a, one__txt="﻿ hello\nthere \n", two__txt="")
    assert [tuple(r) for r in files.read_text_transcripts(spark, str(a)).collect()] == [("one", "hello\nthere")]
    put(b, s__csv="﻿序號,管道,辨識文字\n2,x,later\n1,x, first \n3,x,\n")
    assert [tuple(r) for r in files.read_csv_transcripts(spark, str(b)).collect()] == [("s", "first\nlater")]


def test_unknown_columns(spark, tmp_path):
    put(tmp_path, s__csv="a,b,c\n2,x,later\n1,x,first\n")
    assert [tuple(r) for r in files.read_csv_transcripts(spark, str(tmp_path)).collect()] == [("s", "later\nfirst")]


def test_vocabulary_and_manifest(spark, tmp_path):
    put(tmp_path, v__csv="﻿term,category,boost_value,alert_level,common_error\n# note,,,,\nocc,x,10,2,oc|ok\nbad,x,z,,\n")
    assert [tuple(r) for r in files.read_vocabulary(spark, str(tmp_path)).orderBy("term").collect()] == [("bad", "x", None, None, []), ("occ", "x", 10, 2, ["oc", "ok"])]
    put(tmp_path, v__csv="id,has_gt,duration_sec\na,Y,1.5\nb,N,2\nc,Y,?\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path)).orderBy("id").collect()] == [("a", "Y", 1.5), ("c", "Y", None)]


def test_reports(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    put(tmp_path / "deep", a__json=json.dumps({"timestamp": "20260407_155351", "engine_label": "x", "avg_cer_raw": 0.5}), b__json="{broken", c__txt="no")
    got = files.read_eval_reports(spark, str(tmp_path)).collect()
    assert [(r["engine_label"], r["sample_count"], str(r["run_at"])) for r in got] == [("x", 0, "2026-04-07 15:53:51")]


def test_bundles_and_catalog(spark, tmp_path):
    (tmp_path / "t").mkdir(), (tmp_path / "r").mkdir()
    put(tmp_path / "t", b__txt="head\n【10:20:30】a.wav\nsaid\nmore\n【10:21:00】b.wav\n")
    assert {tuple(r) for r in files.read_bundles(spark, str(tmp_path / "t")).collect()} == {("a", "10:20:30", "said\nmore"), ("b", "10:21:00", "")}
    put(tmp_path / "r", G012_fire_x__wav="x" * 1024, odd__mp3="x" * 512, none__mp3="")
    assert {tuple(r)[1:] for r in files.file_catalog(spark, str(tmp_path / "r")).collect()} == {("G012", "fire", 1.0, "wav"), (None, None, 0.5, "mp3")}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(3, "x,\n", "train"), (1, None, "val"), (2, "", "train")], "id int, text string, split string")
    files.write_jsonl(df, f"{tmp_path}/j", "split")
    assert {tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/j").collect()} == {tuple(r) for r in df.collect()}
    files.write_csv_sorted(df, f"{tmp_path}/c", ["id"])
    assert spark.read.csv(f"{tmp_path}/c", header=True, multiLine=True).count() == 3


def streamed(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_committed_and_chunks(spark, tmp_path):
    rows = [("a", i, 40, t) for i, t in enumerate(["partial", "final", "committed", "final", "final", "final"])] + [("b", 0, 300, "final")]
    put(tmp_path, f__json="\n".join(json.dumps(dict(zip(("channel", "seq", "n_bytes", "type"), r))) for r in rows))
    s = live.watched(spark, str(tmp_path), "channel string, seq long, n_bytes long, type string")
    assert len(streamed(spark, live.committed_only(s), "committed")) == 6
    assert streamed(spark, live.byte_count_chunks(s, 100), "chunks") == {("a", 0, 120), ("a", 1, 120), ("b", 0, 300)}


def test_usage_and_alerts(spark, tmp_path):
    rows = [{"ts": f"2024-01-0{d}T10:00:0{i}", "channel": "c", "engine": "e", "quantity": 2.0, "text": "A FIRE now"} for d, i in ((1, 0), (1, 1), (2, 0))]
    put(tmp_path, f__json="\n".join(map(json.dumps, rows)))
    s = live.watched(spark, str(tmp_path), "ts timestamp, channel string, engine string, quantity double, text string")
    prices, terms = spark.createDataFrame([("e", 0.5)], "engine string, price double"), spark.createDataFrame([("fire", 3), ("now", 1)], "term string, level int")
    usage = streamed(spark, live.live_usage(s, prices), "usage", "update")
    assert {(str(r[0])[:10], *r[1:]) for r in usage} == {("2024-01-01", "c", "e", 2, 2.0), ("2024-01-02", "c", "e", 1, 1.0)}
    assert {r[2] for r in streamed(spark, live.live_keyword_alert(s, terms), "alerts")} == {"fire"}
    assert {r[2] for r in streamed(spark, live.live_keyword_alert(s, terms, most_bytes=0), "alerts_by_key")} == {"fire"}


def test_alerts_by_key(spark):
    lines = spark.createDataFrame([(1, "c", "aXa fire aa"), (2, "c", ""), (3, "c", None), (4, "d", "x")], "ts long, channel string, text string")
    terms = spark.createDataFrame([("fire", 3), ("a", 4), ("xa", 3), ("none", 3)], "term string, level int")
    few, many = (sorted(map(tuple, live.live_keyword_alert(lines, terms, most_bytes=n).collect())) for n in (10_000, 0))
    assert few == many == [(1, "c", "a", 4), (1, "c", "fire", 3), (1, "c", "xa", 3)]


def test_opcodes(spark):
    d = spark.createDataFrame([("abcd", "axcde"), ("", ""), ("ab", "")], "a string, b string")
    d = d.withColumn("o", alignment.opcodes(F.col("a"), F.col("b"))).select("a", "b", alignment.edit_counts(F.col("o")).alias("n"), alignment.block_cer(F.col("o"), F.col("a")).alias("c"), alignment.changed_chars(F.col("o")).alias("k"))
    assert [(tuple(r["n"]), r["c"], r["k"]) for r in d.collect()] == [((1, 0, 1), 0.25, 2), ((0, 0, 0), 0.0, 0), ((0, 2, 0), 1.0, 2)]


def test_alignment_and_fusion(spark):
    assert alignment.aligned(["hello there", "zzz"], ["hello their", "bye"]) == [(0, 0), (1, None), (None, 1)]
    assert alignment.aligned([], ["a"]) == [(None, 0)] and alignment.aligned(["a"], []) == [(0, None)]
    d = spark.createDataFrame([(1, ["the cat sat", "alone"], ["the cat sat!"]), (2, ["a long text here"], ["x"]), (3, None, ["b"])], "id int, a array<string>, b array<string>")
    got = {r["id"]: (r["fused"], r["rules"]) for r in alignment.fuse_sentences(d, ["id"], "a", "b", "zzz", 0.5).collect()}
    assert got == {1: ("the cat sat! alone", ["close", "single"]), 2: ("a long text here", ["whole"]), 3: ("b", ["single"])}


@pytest.mark.parametrize(("given", "wanted"), [
    ("一號收到請回報月台", ["一號收到", "請回報", "月台"]), ("【甲】好的。 x\nOCC 通告全線", ["好的", "OCC 通告全線"]), ("word " * 12, ["word " * 7 + "word", "word word word word"]), ("長" * 90, ["長" * 40, "長" * 40, "長" * 10]), ("", []), (None, None),
])
def test_sentences(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(text.split_sentences(F.col("t"))).first()[0] == wanted


def test_chunks_keep_their_remainder_over_a_restart(spark, tmp_path):
    part = lambda *rows: spark.createDataFrame(rows, "channel string, seq long, n_bytes long")
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    write = lambda s: live.byte_count_chunks(s, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).outputMode("append")
    live.replayed([part(("a", 0, 60), ("b", 0, 99)), part(("a", 1, 30), ("c", 0, 100)), part(("a", 3, 5), ("a", 2, 20), ("b", 1, 1))], write)
    assert {tuple(r) for r in spark.read.schema("channel string, chunk long, n_bytes long").parquet(out).collect()} == {("c", 0, 100), ("a", 0, 110), ("b", 0, 100)}


SHOWN = "channel string, version long, seq long, text string"


def results(spark, *rows):
    d = spark.createDataFrame(rows, "channel string, at long, seq long, type string, text string")
    return d.select("channel", F.timestamp_seconds("at").alias("ts"), "seq", "type", "text")


def test_partials_are_superseded_cleared_and_never_revived(spark, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    first = results(spark, ("a", 1, 1, "partial", "x"), ("a", 2, 2, "partial", "xy"), ("b", 5, 5, "partial", "p"), ("c", 1, 1, "final", "f"), ("d", 1, 1, "partial", None))
    second = results(spark, ("a", 3, 3, "final", "xyz"), ("b", 6, 4, "partial", "late"), ("c", 1, 1, "partial", "late"), ("b", 6, 2, "final", "late"))
    third = results(spark, ("c", 7, 2, "partial", "new"), ("a", 7, 2, "partial", "late"), ("b", 9, 9, "partial", "q"))
    live.replayed([first, second, third], lambda s: live.upserts(live.live_partials(s, 86_400_000, "1 hour"), out, seen))
    assert {tuple(r) for r in live.latest(spark, out, ["channel"], SHOWN).collect()} == {("a", 2, None, None), ("b", 2, 9, "q"), ("c", 1, 2, "new"), ("d", 1, 1, None)}


def test_idle_channels_show_nothing(spark, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    parts = [results(spark, ("a", 100, 1, "partial", "x")), results(spark, ("z", 5000, 1, "partial", "y")), results(spark, ("z", 5001, 2, "partial", "yy"))]
    live.replayed(parts, lambda s: live.upserts(live.live_partials(s, 1000, "1 second"), out, seen))
    assert {r.channel: r.seq for r in live.latest(spark, out, ["channel"], SHOWN).collect()} == {"a": None, "z": 2}


def test_updates_of_a_batch_that_runs_again_replace_each_other(spark, tmp_path):
    out = str(tmp_path / "o")
    for number, n in ((0, 1), (1, 2), (1, 3)):
        spark.createDataFrame([("k", n)], "k string, n int").write.mode("overwrite").parquet(f"{out}/batch={number}")
    assert [tuple(r) for r in live.latest(spark, out, ["k"], "k string, n int").collect()] == [("k", 3)]
