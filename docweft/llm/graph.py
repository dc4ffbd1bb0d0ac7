"""Connected components of a graph given by edges, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b): the least node that it is connected with.

    Each round takes the least label of all neighbours, then the label's own label, so stars end after one round and chains
    after about as many as the logarithm of their length. Labels are written to the shared folder after each round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        lower = labels.join(near, "a").select("a", "root", F.least("root", "r").alias("r"))
        jump = labels.select(F.col("a").alias("r"), F.col("root").alias("r2"))
        fresh = cut(lower.join(jump, "r").select("a", F.least("r", "r2").alias("root"), (F.least("r", "r2") != F.col("root")).alias("changed")))
        done = fresh.filter("changed").isEmpty()
        drop_cut(labels)
        labels = fresh
        if done:
            drop_cut(both)
            return labels.select(F.col("a").alias("node"), "root")
