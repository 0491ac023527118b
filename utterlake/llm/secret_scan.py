"""Secret scans over every version of every text, with a ledger of what has been scanned.

A text is addressed by its content (SHA-256). The ledger holds one row for each (blob, rule version) that has been
scanned, with the spans that were found; only blobs without such a row are scanned, once however many paths have
them, and findings are joined back to all paths. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, shared_dir, small_side, written

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: A private key from its header to its END line, or else over the full base64 lines and a shorter last one.
PEM = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\\s*+[A-Za-z-]++:[^\\n]*+){0,8}+[A-Za-z0-9+/=\\s\\\\]*+-----END [A-Z ]*PRIVATE KEY-----"
    "|(?:\\s*+[A-Za-z-]++:[^\\n]*+){0,8}+(?:(?:\\s|\\\\n)*+[A-Za-z0-9+/]{40,}+={0,2}+)++(?:\\r?\\n[A-Za-z0-9+/]++={0,2}+(?=[ \\t\\r]*+(?![^\\n])))?+)?+"
)

RULES = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # A run that is long enough has the same bounds with the least length in the pattern, and shorter runs can't hold another match.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", PEM, base=False),
)
RULE_VERSION = "3"


def pieces(text: Column, rule: Rule, rank: int) -> Column:
    """An array of struct(rank, i, gap, size, value): of each match of one rule the text between it and the one before it, its length, and its value's."""

    def of(between: Column, match: Column, value: Column) -> Column:
        size = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(between[i]).alias("gap"), F.length(x).alias("size"), F.length(value[i]).alias("value"))
        return F.transform(match, size)

    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else every
    all_three = let(F.split(text, rule.pattern, -1), lambda p: let(every, lambda m: of(p, m, m) if not rule.group else let(value, lambda v: of(p, m, v))))
    return F.when(text.rlike(rule.pattern), all_three).otherwise(F.expr("cast(array() as array<struct<rank:int,i:int,gap:int,size:int,value:int>>)"))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, spans): all spans by start, then by the order of the rules; in code points, end exclusive.

    Places are running sums over what lies between matches, one row each, so work grows with a text's length alone.
    """
    p = let(F.col("text"), lambda t: F.concat(*[pieces(t, r, i) for i, r in enumerate(rules)]))
    rows = texts.select("blob", F.explode_outer(p).alias("x")).select("blob", "x.*")
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    rows = rows.withColumn("end", end)
    kind, least = (F.array(*[F.lit(x) for x in xs])[F.col("rank")] for xs in ([r.kind for r in rules], [r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", kind.alias("kind"))
    found = F.collect_list(F.when(F.col("rank").isNotNull() & (F.col("value") >= least), span))
    return rows.groupBy("blob").agg(F.array_sort(found).cast(SPANS).alias("spans"))


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``versions`` that ``ledger`` lacks at this rule version."""
    t = versions.select(blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = t.groupBy("blob").agg(F.first("text").alias("text"))  # equal blobs have equal texts; copies meet before the shuffle
    if ledger is not None:
        once = once.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan(once).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


class Ledger:
    """The rows of all scans so far, in a folder of Parquet files that only ever gets more of them."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame | None:
        """None before the first scan."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(self.path)

    def extend(self, versions: DataFrame, text_col: str = "text", rule_version: str = RULE_VERSION) -> None:
        """Scan what the ledger lacks, and keep it."""
        scan_unseen(versions, text_col, self.rows(), rule_version).write.mode("append").parquet(self.path)


def beside(versions: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    """``versions`` with ``__spans``, what ``hits`` (blob, spans) has of the text; null where it has nothing."""
    keyed = versions.withColumn("__blob", blob(F.col(text_col)))
    hits = hits.select(F.struct("blob", "spans").alias("__hit"))
    both = keyed.join(small_side(hits, hits.count()), F.col("__blob") == F.col("__hit.blob"), "left")
    return both.select(*[F.col(f"`{c}`") for c in versions.columns], F.col("__hit.spans").alias("__spans"))


def hits_of(ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    return ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")


def findings(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """``versions`` with a column ``__spans``: the ledger's spans of the text, none where it found none."""
    none = F.expr(f"cast(array() as {SPANS})")
    return beside(versions, hits_of(ledger, rule_version), text_col).withColumn("__spans", F.coalesce("__spans", none))


def holes(hits: DataFrame) -> DataFrame:
    """(blob, spans) to (blob, spans) with struct(start, end) that don't overlap: what overlaps becomes one."""
    rows = hits.select("blob", F.posexplode("spans").alias("i", "s")).select("blob", "i", "s.start", "s.end")
    order = Window.partitionBy("blob").orderBy("i")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int")).withColumn("n", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = rows.groupBy("blob", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def reported(docs: DataFrame, ledger: DataFrame, id_col: str, text_col: str) -> DataFrame:
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    f = findings(thin, ledger).select("id", "__spans")
    base = [r.kind for r in RULES if r.base]
    of = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    only = F.filter("__spans", lambda s: s["kind"].isin(base))
    return f.select(F.col("id").alias(id_col), *[of(k) for k in base], F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: counts by base kind, the digest of the base spans, and all spans.

    Null texts count as empty and have no spans. Copies share one scan. Rows with one id are reported each by its
    own text. Other columns are ignored; an empty table gives no rows. What ``ledger`` has isn't scanned again.
    """
    new = written(scan_unseen(docs, text_col, ledger), "secret-ledger")
    return reported(docs, new if ledger is None else ledger.select(*new.columns).unionByName(new), id_col, text_col)


def report_history(versions: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """The :func:`report` on all rows of all versions, of which each in turn goes into the ``ledger``: a version only costs the scan of what it brings."""
    ledger = ledger or Ledger(versions[0].sparkSession)
    thin = [v.select(id_col, text_col) for v in versions]
    for v in thin:
        ledger.extend(v, text_col)
    every = thin[0]
    for v in thin[1:]:
        every = every.union(v)
    return reported(every, ledger.rows(), id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, spans that overlap by one; texts without spans stay as they are.

    Null texts stay null. Repeated rows all stay. Other columns go along, whatever their names; an empty table gives
    no rows.
    """
    new = written(scan_unseen(docs, text_col, ledger), "secret-ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)

    def cut(t: Column, spans: Column) -> Column:
        def around(chars: Column) -> Column:
            def piece(i: Column) -> Column:
                begin = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
                return F.array_join(F.slice(chars, begin + 1, F.coalesce(F.get(spans, i)["start"], F.length(t)) - begin), "")

            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), mark)

        return let(F.split(t, ""), around)

    f = beside(docs, holes(hits_of(whole)), text_col)
    text = F.when(F.col("__spans").isNotNull(), cut(F.col(f"`{text_col}`"), F.col("__spans"))).otherwise(F.col(f"`{text_col}`"))
    return f.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
