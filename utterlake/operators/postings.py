"""Posting lists that change: immutable segments, a log of document versions that makes older postings void, merges by size.

A document's postings carry the version at which it was indexed. The log has a row for each version of a document, and
one for its removal; a posting counts while its version is its document's latest. So an edited text is indexed alone,
and what it replaces goes when its segment is merged. Folders are only ever added to; the manifest of the highest number
says which of them count.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir
from .search import DEALS, posting_lists

#: Segments of one size class that are merged into one, and the ratio of sizes between classes.
MERGE, RATIO = 4, 4
#: Bits of the ids that a merged list spans.
SPAN = 16
LOG = "id long, version long, h long, n int, gone boolean"
SEGMENT = "gram string, ids array<long>, version long"
MANIFEST = "kind string, name string, entries long, version long"


def session_index(spark: SparkSession, name: str) -> PostingIndex:
    """The index that all queries of a session share for what ``name`` stands for."""
    return PostingIndex(spark, f"{shared_dir(spark)}/postings-{spark.sparkContext.applicationId}-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}")


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _manifests(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if done(f.getPath())) if fs.exists(where) else []

    def entries(self) -> list[tuple[str, str, int, int]]:
        """(kind, name, entries, version) of the folders that count."""
        known = self._manifests()
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{known[-1]}").collect()] if known else []

    def _publish(self, entries: list[tuple[str, str, int, int]]) -> None:
        n = (self._manifests() or [0])[-1] + 1
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{n}")

    def _folders(self, kind: str, schema: str) -> DataFrame:
        names = [name for k, name, _, _ in self.entries() if k == kind]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """(id, version, h, n) of the documents that are there, by their latest version; n is the text's length, null for a null text."""
        last = self._folders("log", LOG).groupBy("id").agg(F.max_by(F.struct("version", "h", "n", "gone"), "version").alias("r"))
        return last.select("id", "r.*").where("not gone").drop("gone")

    def live(self) -> DataFrame:
        """(gram, id) of all postings that count."""
        now = self.documents().select("id", "version")
        return self._folders("segment", SEGMENT).select("gram", F.explode("ids").alias("id"), "version").join(now, ["id", "version"], "left_semi").select("gram", "id")

    def sizes(self) -> DataFrame:
        """One row (mean, docs): what ranking needs of all documents."""
        return self.documents().agg(F.avg("n").alias("mean"), F.count("n").alias("docs"))

    def _segment(self, rows: DataFrame) -> tuple[str, int]:
        """Writes lists, those of a trigram to a few files, sorted within; its name and how many postings it has. Ranges of trigrams would have all lists made twice."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.repartition("gram", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(DEALS))).sortWithinPartitions("gram").write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(SEGMENT).parquet(f"{self.path}/{name}").agg(F.sum(F.size("ids"))).first()[0] or 0

    def sync(self, docs: DataFrame, id_col: str, text_col: str, whole: bool = True) -> int:
        """Index what is new or edited in ``docs`` (ids are unique), and with ``whole`` remove what it lacks; says how many documents changed."""
        given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
        old, now = self.entries(), self.documents()
        version = max((v for *_, v in old), default=0) + 1
        new = given.join(now.select("id", "h"), ["id", "h"], "left_anti").withColumn("version", F.lit(version).cast("long"))
        log = new.select("id", "version", "h", F.length("text").alias("n"), F.lit(False).alias("gone"))
        if whole:
            lost = now.join(given.select("id"), "id", "left_anti")
            log = log.union(lost.select("id", F.lit(version).cast("long"), "h", "n", F.lit(True)))
        name = f"log-{uuid.uuid4().hex}"
        log.write.parquet(f"{self.path}/{name}")
        changes = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}")
        n = changes.count()
        if not n:
            return 0
        fresh = given.join(changes.where("not gone").select("id"), "id", "left_semi")
        segment, rows = self._segment(posting_lists(fresh, "id", "text").withColumn("version", F.lit(version).cast("long")))
        self._publish([*old, ("log", name, n, version), ("segment", segment, rows, version)])
        self.merge()
        return n

    def merge(self) -> None:
        """While MERGE segments are of one size class, make them one, without postings that no longer count."""
        while True:
            entries, classes = self.entries(), {}
            for e in entries:
                if e[0] == "segment":
                    classes.setdefault(int(math.log(max(1, e[2]), RATIO)), []).append(e)
            full = next((c for c in classes.values() if len(c) >= MERGE), None)
            if full is None:
                return
            both = self.spark.read.schema(SEGMENT).parquet(*[f"{self.path}/{name}" for _, name, _, _ in full]).select("gram", F.explode("ids").alias("id"), "version")
            counting = both.join(self.documents().select("id", "version"), ["id", "version"], "left_semi")
            segment, rows = self._segment(counting.groupBy("gram", "version", F.shiftright("id", SPAN)).agg(F.collect_list("id").alias("ids")).select("gram", "ids", "version"))
            self._publish([*[e for e in entries if e not in full], ("segment", segment, rows, max(v for *_, v in full))])
