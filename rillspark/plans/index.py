"""The place of each row in a total order, without one task for all rows."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of the order that are numbered apart, and the rows for each of which a sample looks for their bounds.
PARTS, SAMPLED = 64, 64
PART = "__part"
#: A first key of an order that is the range itself: rows that have been dealt by it stay where they are.
RANGE = "__range"
_KINDS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType, T.BinaryType)


class Down(str):
    """The name of a column that is in descending order, nulls last; a plain name is in ascending order, nulls first."""


def sort_columns(order: list[str], backwards: bool = False) -> list[Column]:
    return [F.col(f"`{c}`").desc_nulls_last() if isinstance(c, Down) != backwards else F.col(f"`{c}`").asc_nulls_first() for c in order]


def _literal(value: Any, kind: T.DataType) -> Column:
    return F.lit(str(value) if isinstance(value, datetime.datetime) else value).cast(kind)


def ranged(df: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """df with `__part`, the range of the order that a row falls in, from 0 up; ranges are about as large as one another.

    Their bounds are whole keys, so a first key that many rows share is split by the next. They come from the keys of least
    hash, a uniform sample of SAMPLED rows a part that reaches the driver in a job of its own; they are constants of the
    plan, so a task that runs again deals alike. Keys of other types than numbers, texts, bytes, booleans and times are one range.
    An order that begins with RANGE has its ranges.
    """
    if order[0] == RANGE and not isinstance(order[0], Down):
        return df.withColumn(PART, F.col(RANGE))
    kinds = [df.schema[c].dataType for c in order]
    if not all(isinstance(k, _KINDS) for k in kinds):
        return df.withColumn(PART, F.lit(0))
    keys = [F.col(f"`{c}`") for c in order]
    cast = [k.cast("string") if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else k for k, t in zip(keys, kinds)]
    sample = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *(c.alias(f"s{i}") for i, c in enumerate(cast)), F.xxhash64(*keys).alias("h"))
    found = sample.orderBy("h").limit(SAMPLED * parts).orderBy(*(F.col(f"k{i}").desc_nulls_last() if isinstance(c, Down) else F.col(f"k{i}").asc_nulls_first() for i, c in enumerate(order)))
    rows = [tuple(r[f"s{i}"] for i in range(len(order))) for r in found.collect()]
    bounds = list(dict.fromkeys(rows[len(rows) * i // parts] for i in range(1, parts) if rows))
    if not bounds:
        return df.withColumn(PART, F.lit(0))
    names = [f"b{i}" for i in range(len(order))]
    limits = F.array(*(F.struct(*(_literal(v, k).alias(n) for v, k, n in zip(b, kinds, names))) for b in bounds))

    def before(b: Column) -> Column:
        """Whether a bound stands before the row."""
        out = F.lit(False)
        for key, name, c in reversed(list(zip(keys, names, order))):
            less = F.when(b[name].isNull(), key.isNotNull()).when(key.isNull(), False).otherwise(b[name] < key)
            more = F.when(key.isNull(), b[name].isNotNull()).when(b[name].isNull(), False).otherwise(b[name] > key)
            out = F.when(b[name].eqNullSafe(key), out).otherwise(more if isinstance(c, Down) else less)
        return out

    return df.withColumn(PART, F.size(F.filter(limits, before)))


def offsets(per_part: DataFrame, n: str, *others: str) -> DataFrame:
    """per_part (__part, n, others; a row a part) with the sum of n over the parts before: at most PARTS rows, so one task and a broadcast do."""
    before = F.coalesce(F.sum(n).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(per_part.select(F.col(PART).alias("__p"), before.cast("bigint").alias("__before"), *others))


def with_sum(df: DataFrame, order: list[str], value: Column, name: str, parts: int = PARTS, inclusive: bool = False) -> DataFrame:
    """df with the sum of `value` (a whole number of a row) over the rows before each in order, and of its own if inclusive.

    Sums within ranges of the order, each in a task, plus the totals of the ranges before.
    """
    rows = ranged(df.withColumn("__value", value.cast("bigint")), order, parts)
    totals = rows.groupBy(PART).agg(F.sum("__value").alias("__n"))
    own = F.sum("__value").over(Window.partitionBy(PART).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("__own", own).join(offsets(totals, "__n"), F.col(PART) == F.col("__p"))
    out = F.col("__before") + F.coalesce("__own", F.lit(0)) - (F.lit(0) if inclusive else F.coalesce("__value", F.lit(0)))
    return summed.withColumn(name, out.cast("bigint")).drop(PART, "__p", "__before", "__own", "__value")


def with_index(df: DataFrame, order: list[str], name: str = "_index", parts: int = PARTS) -> DataFrame:
    """df with a column of row numbers from 0 in the order of the keys, which must be unique together; see ranged() and Down."""
    return with_sum(df, order, F.lit(1), name, parts)
