"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import cut, drop_cut


def _least(df: DataFrame) -> DataFrame:
    """The least neighbour of each node, written, so that Spark deals it anew for the join that follows and can split that."""
    return cut(df.groupBy("u").agg(F.min("v").alias("m")), "least")


def _star(edges: DataFrame) -> DataFrame:
    """A large-star step and then a small-star step."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both)
    moved = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = cut(moved, "edges")
    drop_cut(least)
    down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = cut(moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
    drop_cut(least)
    drop_cut(large)
    return out


def _done(edges: DataFrame) -> bool:
    """Whether each node points at one root, and no root points at another."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return twice.union(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: same ordered type); root is the least node of its component.

    Nulls and loops are ignored; an empty edge table gives an empty result. Each round writes its edges to the shared
    folder, so a lost executor costs at most one step; rounds grow with the logarithm of the largest component. Minima
    are pre-aggregated before the shuffle, and hot centres stand on the side of a join that Spark can split.
    """
    least = F.least("a", "b")
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), least.alias("b")).distinct(), "edges")
    while not _done(now):
        after = _star(now)
        drop_cut(now)
        now = after
    # every node now points at its root, or is one
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
