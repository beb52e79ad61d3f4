"""Joins of two flows by null-safe equal keys to records of key, left row and right row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, how: str = "inner", merge: bool = False) -> DataFrame:
    """(key, a, b): every pair of rows with equal keys, null equal to null; `left` and `right` keep unmatched rows with the other side null.

    Catalyst picks the strategy by size, and AQE splits skewed keys; merge=True asks for a sort-merge join.
    """
    if how not in ("inner", "left", "right"):
        raise ValueError(f"join type must be inner, left or right, got {how!r}")
    row = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    left = a.select(key_a.alias("__ka"), row(a).alias("a"))
    right = b.select(key_b.alias("__kb"), row(b).alias("b"))
    if merge:
        right = right.hint("merge")
    found = left.join(right, F.col("__ka").eqNullSafe(F.col("__kb")), how)
    return found.select(F.coalesce("__ka", "__kb").alias("key"), "a", "b")


def merged(flows: list[DataFrame], ordered: bool = False, branch: str = "_branch") -> DataFrame:
    """All rows of all frames, by column name; ordered=True adds the number of the frame that each came from."""
    if not flows:
        raise ValueError("merge needs at least one flow")
    if ordered:
        flows = [f.withColumn(branch, F.lit(i)) for i, f in enumerate(flows)]
    out = flows[0]
    for f in flows[1:]:
        out = out.unionByName(f)
    return out
