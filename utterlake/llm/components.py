"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node with a link: the label is the smallest node of its component.

    Each round takes the smallest label's label among neighbours, gives it to the node and to the node's label (which
    hooks a tree's root on another tree), and then the label's own label; so trees merge and paths shrink together,
    and rounds grow with the logarithm of a path's length. Labels are written after each, which cuts the lineage.
    Ends once no label changes, when neighbours' labels are equal; raises if that takes more than ``rounds`` rounds.
    """
    pairs = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = written(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    for _ in range(rounds):
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("top"))
        tops = written(labels.join(up, labels["label"] == up["at"]).select("node", "label", "top"), "labels")
        near = edges.join(tops, edges["y"] == tops["node"]).groupBy("x").agg(F.min("top").alias("m"))
        low = written(tops.join(near, tops["node"] == near["x"]).select("node", "label", F.least("top", "m").alias("low")), "labels")
        hooks = low.groupBy("label").agg(F.min("low").alias("hook")).select(F.col("label").alias("root"), "hook")
        new = low.join(hooks, low["node"] == hooks["root"], "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("label"))
        new = written(new, "labels")
        moved = new.where("label != old").limit(1).count()
        for old in (labels, tops, low):
            drop_written(old)
        labels = new.select("node", "label")
        labels.written_path = new.written_path
        if not moved:
            drop_written(edges)
            return labels
    raise RuntimeError(f"labels of components still change after {rounds} rounds")
