"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.adapters import spread
from ..sources.files import shared_dir

#: Words are runs of anything but ASCII white space.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a side up to which it is broadcast; counted before, with a shuffle join beyond.
BROADCAST_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A given table; a small one in few files is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable is never inlined, unlike an alias."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


#: Tables written within each :func:`settled` that is under way.
_under_way: list[list[DataFrame]] = []


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors don't take it along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _under_way:
        _under_way[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives as a written table, without the tables that were written on the way."""
    _under_way.append([])
    try:
        df = make()
        path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        made = _under_way.pop()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _under_way:
        _under_way[-1].append(out)
    for old in made:
        drop_written(old)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "written_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows; as it is (a shuffle join, split by AQE where skewed) if not."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
