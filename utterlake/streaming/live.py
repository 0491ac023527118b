"""Operators on live feeds, and how to run one over a table as it arrives. All but those with keyed state also take a batch, with the same result over all of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import keywords
from ..sources.files import scratch


def committed_only(results: DataFrame) -> DataFrame:
    """Partial results are for show; only committed and final ones go on."""
    return results.where(F.col("type").isin("committed", "final"))


#: Rows of a static table up to which it is broadcast.
MOST_RULES = 5_000


def few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def live_usage(usage: DataFrame, prices: DataFrame, late: str = "1 hour", most: int = MOST_RULES) -> DataFrame:
    """(day, channel, engine, calls, cost) from (ts, channel, engine, quantity) and unit prices by engine (static).

    Calls of engines without a price count as calls; with no priced call the cost is null.
    """
    priced = usage.withWatermark("ts", late).join(F.broadcast(prices) if few(prices, most) else prices, "engine", "left")
    g = priced.groupBy(F.window("ts", "1 day").alias("w"), "channel", "engine").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("quantity") * F.col("price")), 6).alias("cost"))
    return g.select(F.col("w.start").alias("day"), "channel", "engine", "calls", "cost")


def live_keyword_alert(lines: DataFrame, terms: DataFrame, least: int = 3, quiet: str = "6 seconds", most_bytes: int = keywords.MOST_BYTES) -> DataFrame:
    """(ts, channel, term, level): terms of at least that level in a line; in a stream each once a channel while ``quiet`` lasts.

    The terms are a static table, looked for in one pass over each line. A line's alerts in a batch aren't reduced.
    """
    t = terms.where(F.col("level") >= least).select(F.lower("term").alias("term"), "level")
    hits = keywords.occurring(lines, ["ts", "channel"], "text", t, "term", most_bytes).join(t, "term")
    if lines.isStreaming:
        hits = hits.withWatermark("ts", quiet).dropDuplicatesWithinWatermark(["channel", "term"])
    return hits.select("ts", "channel", "term", "level")


def byte_count_chunks(frames: DataFrame, target: int) -> DataFrame:
    """(channel, chunk, n_bytes) from a stream of (channel, seq, n_bytes).

    A channel's bytes add up until they reach ``target``; then all of them are one chunk and counting starts again. What a
    channel has at its end stays in state, also over a restart. Frames of one batch are taken by ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, chunk = state.get if state.exists else (0, 0)
        # Most channels have few frames in a batch and end no chunk: what a table costs is only paid where one is needed.
        out, parts = [], list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not rows["seq"].is_monotonic_increasing:
            rows = rows.sort_values("seq")
        for n in rows["n_bytes"].tolist():
            held += int(n)
            if held >= target:
                out.append((key[0], chunk, held))
                held, chunk = 0, chunk + 1
        state.update((held, chunk))
        if out:
            yield pd.DataFrame(out, columns=["channel", "chunk", "n_bytes"])

    kind = frames.schema["channel"].dataType.simpleString()
    return frames.groupBy("channel").applyInPandasWithState(
        step, f"channel {kind}, chunk long, n_bytes long", "held long, chunk long", "append", GroupStateTimeout.NoTimeout
    )


def live_partials(results: DataFrame, idle_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(channel, version, seq, text) from a stream of (channel, ts, seq, type, text): what each channel shows, anew whenever it changes.

    A channel shows its latest partial result until a final one with at least its number comes; then, or once all
    channels' time is ``idle_ms`` past its last row, it shows nothing (null). A partial that is older than what is shown
    or than the last final result changes nothing; rows that are older than the newest by more than ``late`` may be left
    out. ``version`` counts a channel's changes, so the highest one is what it shows now.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, seq, text, final, last = state.get if state.exists else (0, None, None, -1, 0)
        before = (seq, text)
        if state.hasTimedOut:
            seq = text = None
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                last = max(last, int(r.ts.timestamp() * 1000))
                if r.type == "final":
                    final = max(final, int(r.seq))
                elif r.seq > final and (seq is None or r.seq > seq):
                    seq, text = int(r.seq), r.text
                if seq is not None and seq <= final:
                    seq = text = None
        changed = (seq, text) != before
        state.update((version + changed, seq, text, final, last))
        if seq is not None:
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], version + 1, seq, text)] if changed else [], columns=["channel", "version", "seq", "text"]).astype({"seq": "Int64"})

    kind = results.schema["channel"].dataType.simpleString()
    return results.withWatermark("ts", late).groupBy("channel").applyInPandasWithState(
        step, f"channel {kind}, version long, seq long, text string", "version long, seq long, text string, final long, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def watched(spark: SparkSession, folder: str, schema: str, kind: str = "json", per_batch: int = 1000) -> DataFrame:
    """Files as they arrive in a folder; the query's checkpoint knows which it has seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def folder_stream(lines: DataFrame, text_col: str, rewrite: Callable[[Column], Column], out: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each arriving line, with its rewritten text in ``final``, to the Parquet folder ``out``."""
    done = lines.withColumn("final", rewrite(F.col(text_col)))
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def upserts(changes: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """A writer of an updating stream: each micro-batch's changed rows become the folder ``batch=<number>``, written over if it is run again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """What :func:`upserts` has written: of each key the row of its last micro-batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def replayed(arrivals: list[DataFrame], run: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Streams a table as its parts arrive in a folder, one after the other: after each the query runs until all is seen, stops, and starts again from its checkpoint.

    ``run`` makes a writer of the stream; it is called for every start and has to name the same checkpoint each time.
    """
    spark = arrivals[0].sparkSession
    at = scratch(spark, "arrivals")
    for part in arrivals:
        part.write.mode("append").parquet(at)
        lines = spark.readStream.schema(part.schema).parquet(at)
        run(lines).trigger(availableNow=True).start().awaitTermination()
