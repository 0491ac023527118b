"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source, targets are shared out by weight under a cap, and each document is emitted
floor(rate) times plus one copy by a Bernoulli draw seeded by a hash, with the rate's fraction as probability.
The draw is u(document) + shift, modulo 1. Each source uses the one of SHIFTS fixed shifts whose mix comes nearest
its target: any shift gives each document the same probability, but the sum strays less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, small_side, words, written

#: Fixed values of the contract: weights by turn, share of all sizes, cap on repetition.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SHIFTS = 32
SEED = "mix-1"


def size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def draw(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) from a hash of the id and the seed; of a row without id, its text takes the id's place."""
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    hexed = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("string"), unnamed)))
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def shifted(u: Column, k: Column | int) -> Column:
    """u moved by k / SHIFTS around the unit circle."""
    v = u + (k if isinstance(k, Column) else F.lit(k)) / F.lit(float(SHIFTS))
    return F.when(v >= 1, v - 1).otherwise(v)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums of what comes before each in a total order. Rows are cut into ranges of the order: sums of ranges go over the ranges, those within one over its rows."""
    cut = written(rows.withColumns(sums).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    behind = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy("part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # a row per range
    whole = whole.select("part", *[F.coalesce(F.sum(f"__{c}").over(behind(Window.orderBy("part"))), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = behind(Window.partitionBy("part").orderBy(*order))
    within = cut.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return within.join(F.broadcast(whole), "part").select(*rows.columns, *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by water filling.

    A source is capped at CAP times its size if the level (target per weight) of what is left lies above its own
    cap per weight; sorted by that ratio, the capped ones come first, so one running sum finds the level that
    resharing the excess again and again ends at. Sources are ordered by ranges, never in one task.
    """
    by_source = F.col("source").asc_nulls_last()
    s = running(sizes, [by_source], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight")).withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
    s = running(s, [F.col("ratio").asc(), by_source], {"capped": F.col("source_size"), "capped_weight": F.col("weight")})
    total, total_weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    s = s.withColumn("level", (SHARE * F.lit(total) - CAP * F.col("capped")) / (F.lit(total_weight) - F.col("capped_weight")))
    # The level is that at the first source whose own cap lies at or above it; later ones give lower levels.
    level = s.agg(F.coalesce(F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))), F.max("ratio"))).first()[0]
    return s.select("source", "source_size", F.least(CAP * F.col("source_size"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(id, source, size, u) of every row, as a written table; (source, source_size, target, rate, shift) of every source; and their number."""
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("u")),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = settled(lambda: targets(sizes).withColumn("rate", rate), "mix-targets")
    n = t.count()
    seen = rows.join(small_side(t.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    taken = seen.groupBy("source").agg(*[F.sum(F.col("size") * copies(F.col("rate"), F.col("u"), k)).alias(f"t{k}") for k in range(SHIFTS)])
    near = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("d"), F.lit(k).alias("k")) for k in range(SHIFTS)])
    both = t.join(small_side(taken.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    return rows, written(both.select("source", "source_size", "target", "rate", F.array_min(near)["k"].alias("shift")), "mix-plan"), n


def copies(rate: Column, u: Column, shift: Column | int) -> Column:
    """floor(rate), and one more if the draw falls below its fraction."""
    return F.floor(rate) + F.when(shifted(u, shift) < rate - F.floor(rate), 1).otherwise(0)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, and the words that the mix takes of it.

    A null source is a source of its own, last in order. Null and empty texts have size 0. Rows with one id share
    its draw, so copies of a row are taken alike; rows without id draw by their text. Other columns are ignored; an empty table gives no rows.
    """
    rows, per_source, n = plan(docs, id_col, text_col, source_col)
    r = rows.join(small_side(per_source.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    return r.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("u"), F.col("shift"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as the mix takes it."""
    _, per_source, n = plan(docs, id_col, text_col, source_col)
    p = small_side(per_source.select(F.struct("source", "rate", "shift").alias("__mix")), n)
    r = docs.join(p, F.col(source_col).eqNullSafe(F.col("__mix.source")))
    times = copies(F.col("__mix.rate"), draw(F.col(id_col), F.col(text_col)), F.col("__mix.shift")).cast("int")
    repeated = r.withColumn("__copy", F.explode(F.when(times > 0, F.array_repeat(F.lit(1), times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The same in SQL, for DuckDB."""
    u = f"('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id AS varchar), 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE / {float(2**48)}"

    def times(shift: str) -> str:
        v = f"(u + {shift} / {float(SHIFTS)})"
        return f"(CAST(floor(rate) AS BIGINT) + CASE WHEN (CASE WHEN {v} >= 1 THEN {v} - 1 ELSE {v} END) < rate - floor(rate) THEN 1 ELSE 0 END)"

    return f"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, {u} AS u FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM z),
q AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0.0) AS capped_weight, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight FROM q
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * capped) / (total_weight - capped_weight) AS level FROM c),
g AS (SELECT *, coalesce(max(CASE WHEN ratio >= level THEN level END) OVER (), max(ratio) OVER ()) AS lv FROM l),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, lv * weight) AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
j AS (SELECT r.*, p.source_size, p.target, p.rate FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, k, abs(sum(size * {times("k")}) - any_value(target)) AS d FROM j, range({SHIFTS}) x(k) GROUP BY source, k),
b AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, k) AS n FROM e) WHERE n = 1)
SELECT doc_id, size, source_size, target, CAST(size * {times("b.k")} AS BIGINT) AS taken FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source"""
