"""Registered queries that run as streams: a table arrives in parts, and after each part the query is started again from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..streaming import live
from . import queries as q
from .adapters import USAGE, VOCABULARY, table, usage, vocabulary
from .queries import query


def turns(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The conversations' turns, in three parts as they are said."""
    c = table(spark, sf_dir, "conversations")
    return [c.where("turn < 2"), c.where("turn >= 2 and turn < 5"), c.where("turn >= 5 or turn is null")]


def kept(spark: SparkSession, arrivals: list[DataFrame], on, schema: str) -> DataFrame:
    """The rows that a stream over the arrivals adds to a folder."""
    out, seen = scratch(spark, "stream-out"), scratch(spark, "stream-seen")
    live.replayed(arrivals, lambda lines: on(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).outputMode("append"))
    return spark.read.schema(schema).parquet(out)


LIVE = {"click": 0.1, "view": 0.2, "purchase": 0.3}


@query(f"""SELECT date_trunc('day', ts) AS day, u.channel, u.engine, count(*) AS calls, round(coalesce(sum(audio_seconds * price), 0), 3) AS cost FROM {USAGE} u
LEFT JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LIVE.items())}) p(engine, price) ON u.engine = p.engine GROUP BY 1, 2, 3""")
def live_usage(spark, sf_dir):
    """Metering rows in three parts by time; each micro-batch writes the days it changes, and the last one of a day counts."""
    prices = spark.createDataFrame(list(LIVE.items()), "engine string, price double")
    feed = usage(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "channel", "engine", F.col("audio_seconds").alias("quantity"))
    cuts = [F.lit(d).cast("timestamp") for d in ("2024-01-11", "2024-01-21")]
    parts = [feed.where(F.col("ts") < cuts[0]), feed.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), feed.where(F.col("ts") >= cuts[1])]
    out, seen = scratch(spark, "stream-out"), scratch(spark, "stream-seen")
    live.replayed(parts, lambda lines: live.upserts(live.live_usage(lines, prices), out, seen))
    days = live.latest(spark, out, ["day", "channel", "engine"], "day timestamp, channel string, engine string, calls long, cost double")
    return days.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("cost", F.round(F.coalesce("cost", F.lit(0.0)), 3))


@query(f"SELECT DISTINCT conv_id, k.term, k.level FROM conversations JOIN {VOCABULARY} k ON contains(lower(text), k.term) WHERE k.level >= 3")
def live_keyword_alert(spark, sf_dir):
    """A turn is a second, and an hour of quiet follows an alert, so a conversation has each term once, over all restarts."""
    said = [t.select(F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"), F.col("conv_id").alias("channel"), "text") for t in turns(spark, sf_dir)]
    words = vocabulary(spark, sf_dir)
    hits = kept(spark, said, lambda lines: live.live_keyword_alert(lines, words, quiet="1 hour"), "ts timestamp, channel long, term string, level int")
    return hits.select(F.col("channel").alias("conv_id"), "term", "level")


@query("SELECT conv_id, turn, text FROM conversations WHERE role IN ('assistant', 'user')")
def committed_only(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "final").when(F.col("role") == "user", "committed").otherwise("partial")
    said = [t.select("conv_id", "turn", "text", kind.alias("type")) for t in turns(spark, sf_dir)]
    return kept(spark, said, lambda lines: live.committed_only(lines).select("conv_id", "turn", "text"), "conv_id long, turn long, text string")


CHUNK = 2_000


@query(f"""WITH RECURSIVE f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, coalesce(strlen(text), 0) AS n FROM conversations),
s AS (SELECT conv_id, k, CASE WHEN n >= {CHUNK} THEN 0 ELSE n END AS held, CASE WHEN n >= {CHUNK} THEN 1 ELSE 0 END AS chunks, CASE WHEN n >= {CHUNK} THEN n END AS done FROM f WHERE k = 1
UNION ALL SELECT f.conv_id, f.k, CASE WHEN held + n >= {CHUNK} THEN 0 ELSE held + n END, chunks + CASE WHEN held + n >= {CHUNK} THEN 1 ELSE 0 END, CASE WHEN held + n >= {CHUNK} THEN held + n END
FROM s JOIN f ON f.conv_id = s.conv_id AND f.k = s.k + 1)
SELECT conv_id AS channel, CAST(chunks - 1 AS BIGINT) AS chunk, CAST(done AS BIGINT) AS n_bytes FROM s WHERE done IS NOT NULL""")
def byte_count_chunks(spark, sf_dir):
    """Turns as frames of bytes; a conversation's remainder is kept in state over the restarts and is no chunk."""
    said = [t.select(F.col("conv_id").alias("channel"), F.col("turn").alias("seq"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")) for t in turns(spark, sf_dir)]
    return kept(spark, said, lambda lines: live.byte_count_chunks(lines, CHUNK), "channel long, chunk long, n_bytes long")


@query(q.ORACLE["partial_supersede"])
def live_partials(spark, sf_dir):
    """What each conversation shows after its last turn: a partial result that no final one has replaced."""
    kind = F.when(F.col("role") == "assistant", "final").otherwise("partial")
    said = [t.select(F.col("conv_id").alias("channel"), F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"), F.col("turn").alias("seq"), kind.alias("type"), "text") for t in turns(spark, sf_dir)]
    out, seen = scratch(spark, "stream-out"), scratch(spark, "stream-seen")
    live.replayed(said, lambda lines: live.upserts(live.live_partials(lines, 86_400_000, "1 hour"), out, seen))
    shown = live.latest(spark, out, ["channel"], "channel long, version long, seq long, text string")
    return shown.where("seq is not null").select(F.col("channel").alias("conv_id"), F.col("seq").alias("turn"), "text")
