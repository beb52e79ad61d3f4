"""Folds, groups, runs and firsts over DataFrames with explicit order."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.plans.index import PART, PARTS, offsets, ranged, sort_columns, with_index


def ordered_values(df: DataFrame, order: list[str], value: Column | None = None) -> Column:
    """An aggregate: the values (default: whole rows) as an array in order. Nulls stay, since each stands in a record with its keys."""
    value = value if value is not None else F.struct(*(F.col(f"`{c}`") for c in df.columns))
    pairs = F.collect_list(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), value.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def collect_all(df: DataFrame, order: list[str], value: Column | None = None, name: str = "value") -> DataFrame:
    """One row with an array of everything in order; no rows give an empty array."""
    return df.agg(ordered_values(df, order, value).alias(name))


def batches(df: DataFrame, order: list[str], size: float, value: Column | None = None) -> DataFrame:
    """(batch, values): consecutive groups of `size` rows, the last one what is left. A fractional size is rounded up."""
    n = batch_size(size)
    rows = with_index(df, order, "__at")
    return rows.groupBy(F.floor(F.col("__at") / n).cast("bigint").alias("batch")).agg(ordered_values(df, order, value).alias("values"))


def batch_size(size) -> int:
    try:
        n = float(size)
    except (TypeError, ValueError):
        n = float("nan")
    if n != n:
        raise ValueError(f"batch size must be a number, got {size!r}")
    return max(1, -int(-n // 1))


def fold(df: DataFrame, order: list[str], init: Column, step: Callable[[Column, Column], Column], by: list[str] | None = None, value: Column | None = None, name: str = "value") -> DataFrame:
    """A left fold in order, over everything or within groups; without rows, over everything, it is init."""
    values = ordered_values(df, order, value)
    if by:
        return df.groupBy(*by).agg(F.aggregate(values, init, step).alias(name))
    return df.agg(F.aggregate(values, init, step).alias(name))


def fold1(df: DataFrame, order: list[str], step: Callable[[Column, Column], Column], by: list[str] | None = None, value: Column | None = None, name: str = "value") -> DataFrame:
    """A left fold that begins with the first value; without rows, over everything, null."""
    values = ordered_values(df, order, value)
    out = F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), step)).alias(name)
    return df.groupBy(*by).agg(out) if by else df.agg(out)


def groups(df: DataFrame, key: Column, order: list[str], value: Column | None = None) -> DataFrame:
    """(key, values): one row for each key, rows in order; null keys are one group."""
    return df.groupBy(key.alias("key")).agg(ordered_values(df, order, value).alias("values"))


def index_by(df: DataFrame, key: Column, strict: bool = True) -> DataFrame:
    """(key, value): the one row of each key. A key with more, two nulls too, raises when it is read; else see repeated_keys()."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    message = F.concat(F.lit("Multiple values per key: "), F.coalesce(key.cast("string"), F.lit("null")))
    rows = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.first(row).alias("value"), F.first(message).alias("message"))
    if not strict:
        return rows.where("n = 1").select("key", "value")
    return rows.select("key", F.when(F.col("n") > 1, F.raise_error(F.col("message"))).otherwise(F.col("value")).alias("value"))


def repeated_keys(df: DataFrame, key: Column) -> DataFrame:
    """(key, n, message) of keys that more than one row has."""
    message = F.concat(F.lit("Multiple values per key: "), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").withColumn("message", message)


def runs(df: DataFrame, key: Column, order: list[str], parts: int = PARTS) -> DataFrame:
    """(run, key, values): runs of neighbours with equal keys, in order; a key that comes back begins another run.

    A run starts where the key differs from the row before. Ranges of the order look back apart, the last key of the range
    before is handed to the first row of each, and the starts of ranges, a row each, are summed to offsets.
    """
    rows = ranged(df.withColumn("__key", key), order, parts)
    own = Window.partitionBy(PART).orderBy(*sort_columns(order))
    before = F.lag(F.struct("__key")).over(own)
    place = F.struct(*(F.col(f"`{c}`") for c in order))  # nulls come first
    last = rows.groupBy(PART).agg(F.max_by(F.struct("__key"), place).alias("__last"))
    last = last.select(F.col(PART).alias("__q"), F.lag("__last").over(Window.orderBy(PART)).alias("__edge"))
    looked = rows.withColumn("__look", before).join(F.broadcast(last), F.col(PART) == F.col("__q")).withColumn("__look", F.coalesce("__look", "__edge"))
    starts = looked.withColumn("__starts", (F.col("__look").isNull() | ~F.col("__look.__key").eqNullSafe(F.col("__key"))).cast("bigint"))
    numbered = starts.withColumn("__own", F.sum("__starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    totals = offsets(numbered.groupBy(PART).agg(F.sum("__starts").alias("__n")), "__n")
    numbered = numbered.join(totals, F.col(PART) == F.col("__p")).withColumn("run", F.col("__before") + F.col("__own") - 1)
    return numbered.groupBy("run").agg(F.first("__key").alias("key"), ordered_values(numbered, order, F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("values"))


def first_of_each(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row in order of each tuple of keys; null is a key like any other. Firsts are taken before the shuffle too."""
    row, place = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*(F.col(f"`{c}`") for c in order))
    return df.groupBy(*(k.alias(f"__u{i}") for i, k in enumerate(keys))).agg(F.min_by(row, place).alias("__row")).select("__row.*")


def until(df: DataFrame, condition: Column, order: list[str], inclusive: bool = True) -> DataFrame:
    """The rows in order up to the first one that meets the condition, with it if `inclusive`; all rows if none does.

    The first is found by a distributed minimum of the keys, one row that is broadcast; nothing is sorted.
    """
    key = F.struct(*(F.struct(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")) for c in order))
    stop = df.where(F.coalesce(condition, F.lit(False))).agg(F.min(key).alias("__stop"))
    found = df.crossJoin(F.broadcast(stop))
    within = key <= F.col("__stop") if inclusive else key < F.col("__stop")
    return found.where(F.col("__stop").isNull() | within).drop("__stop")


def spaced(df: DataFrame, by: list[str], time: str, order: list[str], seconds: float) -> DataFrame:
    """Leading-edge sampling by event time: a row stays if `seconds` or more have gone since the last that stayed, in each group.

    Each row hangs on what stayed before it, so a group's rows pass in order through one task, which holds a batch of them
    and the time of the last that stayed, and jumps from one that stays to the next. Rows without a time stay.
    """
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in by)), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.withColumns({"__t": micros, "__k": key}).repartition("__k").sortWithinPartitions("__k", "__t", *sort_columns(order))
    least = int(seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for b in batches:
            keys = b.column(b.num_columns - 1).to_pylist()
            timed = b.column(b.num_columns - 2)
            kept = np.asarray(timed.is_null()).copy()
            at = 0
            while at < len(keys):
                end = bisect.bisect_right(keys, keys[at], at)
                if keys[at] != group:
                    group, last = keys[at], None
                own = np.nonzero(~kept[at:end])[0] + at
                times = timed.take(pa.array(own)).to_numpy(zero_copy_only=False) if len(own) else own
                i = 0 if last is None else int(np.searchsorted(times, last + least))
                while i < len(own):
                    kept[own[i]] = True
                    last = int(times[i])
                    i = max(i + 1, int(np.searchsorted(times, last + least)))
                at = end
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]).filter(pa.array(kept))

    return rows.mapInArrow(run, df.schema)


def release_slots(df: DataFrame, order: list[str], num: int, ms: int, name: str = "release_ms") -> DataFrame:
    """Rate limiting of a batch: the milliseconds after the start at which each row is let go, `num` rows every `ms`. Nothing is dropped."""
    if num < 1 or ms < 0:
        raise ValueError("ratelimit needs num >= 1 and ms >= 0")
    return with_index(df, order, "__at").withColumn(name, (F.floor(F.col("__at") / num) * ms).cast("bigint")).drop("__at")
