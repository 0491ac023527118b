"""Readers and writers of transcript files. Each reads a folder or pattern of many files as one distributed table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_bundle

#: The columns a transcript's text or order may be in, first found first.
TEXT_COLUMNS = ("辨識文字", "transcript", "text", "內容")
ORDER_COLUMNS = ("序號", "id", "index")
BOM = "﻿"


def stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def unmarked(c):
    return F.regexp_replace(c, f"^{BOM}", "")


def read_text_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text): each text file whole, without a byte order mark and outer white space. Empty files give no row."""
    t = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("stem"), unmarked(F.col("value")).alias("text"))
    return t.select("stem", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def read_csv_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text): the text column of each CSV file, lines in order. All files of a call share their header.

    The text is in the first known column, else in the third (first, if there are fewer); lines follow the number column,
    or without one the place in the file.
    """
    c = spark.read.csv(path, header=True, multiLine=True)
    names = {n.lstrip(BOM): n for n in c.columns}
    said = next((names[n] for n in TEXT_COLUMNS if n in names), c.columns[2 if len(c.columns) > 2 else 0])
    number = next((names[n] for n in ORDER_COLUMNS if n in names), None)
    at = F.coalesce(F.col(f"`{number}`").try_cast("long"), F.lit(0)) if number else F.lit(0)
    lines = c.select(stem(F.col("_metadata.file_path")).alias("stem"), at.alias("at"), F.monotonically_increasing_id().alias("row"), F.trim(F.col(f"`{said}`")).alias("line"))
    g = lines.where("line != ''").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("at", "row", "line"))).alias("l"))
    return g.select("stem", F.array_join("l.line", "\n").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Index rows that have a ground truth, with numbers as such."""
    m = spark.read.csv(path, header=True).where("has_gt = 'Y'")
    kinds = {"duration_sec": "double", "gt_char_count": "int", "gt_speaker_lines": "int", "audio_size_kb": "double"}
    return m.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items() if c in m.columns})


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Terms without comment and empty rows; ``common_error`` as an array."""
    v = spark.read.csv(path, header=True)
    v = v.toDF(*[c.lstrip(BOM) for c in v.columns]).where("trim(term) != '' and not startswith(ltrim(term), '#')")
    return v.withColumns({"boost_value": F.col("boost_value").try_cast("int"), "alert_level": F.col("alert_level").try_cast("int"), "common_error": F.filter(F.split(F.coalesce("common_error", F.lit("")), r"\|"), lambda x: x != "")})


REPORT = "timestamp string, engine_label string, post_process_stages array<string>, sample_count int, success_count int, avg_cer_raw double, avg_cer_final double, by_event_type map<string, struct<count:int, avg_cer_raw:double, avg_cer_final:double>>"


def read_eval_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports of a folder and those below it, one JSON document a file; what can't be read is left out, missing fields get defaults."""
    r = spark.read.schema(f"{REPORT}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    r = r.select("*", F.col("_metadata.file_name").alias("source_json")).where("_bad is null and engine_label is not null").drop("_bad")
    return r.na.fill(0, ["sample_count", "success_count"]).withColumn("run_at", F.try_to_timestamp("timestamp", F.lit("yyyyMMdd_HHmmss")))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(stem, name, body): records of bundle files, each opened by its clock mark and file name."""
    b = read_text_transcripts(spark, path).select(F.explode(parse_bundle(F.col("text"))).alias("b"))
    return b.select(stem(F.regexp_extract("b.body", r"^(\S+)", 1)).alias("stem"), F.col("b.name").alias("clock"), F.trim(F.regexp_replace("b.body", r"^\S+\s*", ""), F.lit(" \n")).alias("body"))


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, event_type, size_kb, format) of recordings; contents aren't read. Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    s, pattern = stem(F.col("path")), r"^([A-Z]?\d{3,4})_(\w+?)_(.+)$"
    part = lambda i: F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))
    return f.select("path", part(1).alias("id"), part(2).alias("event_type"), F.round(F.col("length") / 1024, 1).alias("size_kb"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


def write_csv_sorted(df: DataFrame, path: str, by: list[str], mark: bool = False) -> None:
    """Files whose names follow the order of their rows: a range sort, no single task. With ``mark`` each file begins with a byte order mark."""
    out = df.orderBy(*by)
    first, *rest = out.columns
    out = out.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *[F.col(f"`{c}`") for c in rest]) if mark else out
    out.write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """JSON Lines, a folder for each value of ``split``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(split) if split else w).json(path)


#: Columns of the run history and of its shares by event, with their types; times count milliseconds.
HISTORY = {"timestamp": "string", "timestamp_iso": "string", "timestamp_unix": "long", "engine_label": "string", "post_process": "string"}
RATES = {"avg_cer_raw": "double", "avg_cer_final": "double", "avg_improvement": "double"}
SYNCED = {
    "cer_history": {**HISTORY, "sample_count": "long", "success_count": "long", **RATES, "avg_wer_final": "double", "source_json": "string"},
    "cer_event_type_history": {**HISTORY, "event_type": "string", "sample_count": "long", **RATES, "source_json": "string"},
}


#: By application, the temporary folder where none is named.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a temporary one only where it is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[own]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    at = scratch(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def typed(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of ``kinds`` in that order: what can't be cast, and columns that are missing, become null.

    A file of shares by event calls its number of samples ``count``.
    """
    name = lambda c: c if c in raw.columns else {"sample_count": "count"}.get(c, c)
    return raw.select(*[(F.trim(F.col(f"`{name(c)}`")).try_cast(t) if name(c) in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def full_refresh_sync(spark: SparkSession, history: str, by_event: str, out: str) -> None:
    """Rebuilds both tables below ``out`` from their CSV files and adds a row with their sizes to ``cer_sync_log``."""
    for (name, kinds), path in zip(SYNCED.items(), (history, by_event), strict=True):
        typed(spark.read.csv(path, header=True, multiLine=True), kinds).write.mode("overwrite").parquet(f"{out}/{name}")
    sizes = [spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias(n)) for name, n in zip(SYNCED, ("history_rows", "event_rows"), strict=True)]
    now = F.current_timestamp()
    log = sizes[0].crossJoin(sizes[1]).select(now.alias("synced_at"), F.unix_millis(now).alias("synced_unix"), "history_rows", "event_rows")
    log.write.mode("append").parquet(f"{out}/cer_sync_log")
