"""Connected components by contraction: every node joins its least neighbour, and links between what has met are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node that links reach, for every node of a link.

    Links may repeat or stand in both directions. Each round points every node
    at its least neighbour (if less than itself), follows two pointers, and
    rewrites the links between what the nodes have become; equal ends drop out.
    Nodes at least halve in a round, and links shrink with them. Minima are
    pre-aggregated in each task; all tables are written to the shared folder.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    left = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(low.alias("u"), high.alias("v")).distinct()
    left = _store.stored(left, "links")
    labels = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("label", F.col("node"))
    while not left.isEmpty():
        ends = left.union(left.select("v", "u"))
        parent = _store.stored(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("up")), "parents")
        over = parent.select(F.col("u").alias("up"), F.col("up").alias("top"))
        top = _store.stored(parent.join(over, "up").select("u", "top"), "tops")
        labels = labels.join(top, labels.label == top.u, "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = _store.stored(labels, "labels")
        one, two = top.toDF("u", "_u"), top.toDF("v", "_v")
        moved = left.join(one, "u").join(two, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u != v")
        left = _store.stored(moved.select(low.alias("u"), high.alias("v")).distinct(), "links")
    return labels
