"""Operators on trees as tables: a node has its ``path`` (array of sortable keys from the root), so no query recurses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import spread_rank


def prefixes(df: DataFrame, *columns: str, own: bool = False) -> DataFrame:
    """A row for each ancestor of each node (and the node itself): ``up`` is its path. Joins on ``up`` are equi joins."""
    last = F.size("path") - (0 if own else 1)
    ups = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda n: F.slice("path", 1, n)))
    return df.select("path", *columns, F.explode(ups).alias("up"))


def with_children(nodes: DataFrame) -> DataFrame:
    """The nodes with ``n_children``, ``is_leaf``, ``parent`` path and ``depth`` (0 at the top)."""
    parent = nodes.filter(F.size("path") > 1).groupBy(F.slice("path", 1, F.size("path") - 1).alias("path")).agg(F.count("*").alias("n_children"))
    out = nodes.join(parent, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.withColumns({"is_leaf": F.col("n_children") == 0, "parent": F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1)), "depth": F.size("path") - 1})


def subtree_sum(nodes: DataFrame, value: str) -> DataFrame:
    """path, total, n: sums over each node's subtree; rows meet their ancestors by key and combine map-side."""
    return prefixes(nodes, value, own=True).groupBy(F.col("up").alias("path")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def roll_up(nodes: DataFrame, low: str, high: str) -> DataFrame:
    """path, low, high: the least and greatest page of each subtree."""
    return prefixes(nodes, low, high, own=True).groupBy(F.col("up").alias("path")).agg(F.min(low).alias(low), F.max(high).alias(high))


def prune(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes without those in ``roots`` (path) and all below them."""
    cut = prefixes(nodes, own=True).join(roots.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return nodes.join(cut, "path", "left_anti")


def drop_repeated_in_descendants(items: DataFrame, value: str) -> DataFrame:
    """Items (path, value) without those that some node below has as well; siblings are not compared."""
    below = prefixes(items, value).select(F.col("up").alias("path"), value).distinct()
    return items.join(below, ["path", value], "left_anti")


def preorder(nodes: DataFrame, within: int, cell_keys: int = 1_000) -> DataFrame:
    """The nodes with ``place`` in pre-order within each subtree at depth ``within``: paths sort as the walk visits them.

    A subtree is cut by its next keys, so that one with a third of all nodes is not numbered in one task.
    """
    nodes = nodes.withColumn("_top", F.slice("path", 1, within))
    cell = F.coalesce(F.floor(F.try_element_at("path", F.lit(within + 1)) / cell_keys), F.lit(-1))
    return spread_rank(nodes, ["_top"], cell, "path").drop("_top")


def next_outside(nodes: DataFrame) -> DataFrame:
    """path, next_path: the first node after a node's whole subtree; null at the end.

    It is the next sibling of the node, or of its nearest ancestor that has one. Siblings are numbered by parent, and a node
    meets its ancestors by key.
    """
    parent = F.slice("path", 1, F.size("path") - 1)
    line = Window.partitionBy(parent).orderBy("path")
    following = nodes.select("path").distinct().select(F.col("path").alias("up"), F.lead("path").over(line).alias("_next")).filter("_next is not null")
    hits = prefixes(nodes.select("path").distinct(), own=True).join(following, "up")
    found = hits.groupBy("path").agg(F.max_by("_next", F.size("up")).alias("next_path"))
    return nodes.join(found, "path", "left")
