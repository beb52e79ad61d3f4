"""Flow: everyday operators of a functional stream library over a DataFrame with an explicit order."""

from __future__ import annotations

import asyncio
import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rillspark.functions import text, values
from rillspark.operators import grouping, joins, outcomes
from rillspark.plans.index import RANGE, Down, sort_columns, with_index
from rillspark.plans.pipeline import Pipeline
from rillspark.sources.build import POSITION, frame_of
from rillspark.streaming import tasks

Condition = Column | str | Callable


def flow(spark: SparkSession, xs: Any = (), schema: str | None = None, order: list[str] | str | None = None, limit: int | None = None) -> Flow:
    """A flow of a DataFrame, records, an (async) iterable, an awaitable or a generator function; a flow is itself.

    A DataFrame's order is what `order` names; others come in the order of their position, column _pos.
    """
    if isinstance(xs, Flow):
        return xs
    df = frame_of(spark, xs, schema, limit)
    if order is None and not isinstance(xs, DataFrame):
        order = [POSITION]
    return Flow(df, order)


def is_flow(x: Any) -> bool:
    return isinstance(x, Flow)


def is_pipeline(x: Any) -> bool:
    return isinstance(x, Pipeline)


class Writer:
    """A source that is pushed into: write() values, end(), and flow() gives what was written; writing after the end is refused."""

    def __init__(self, spark: SparkSession, schema: str | None = None):
        self._spark, self._schema, self._items, self._ended = spark, schema, [], False

    def write(self, *items: Any) -> Writer:
        if self._ended:
            raise ValueError("write after end")
        self._items += items
        return self

    def end(self) -> Flow:
        self._ended = True
        return self.flow()

    def flow(self) -> Flow:
        return flow(self._spark, list(self._items), self._schema)


class Flow:
    """An immutable chain step: a DataFrame, and the columns that put its rows in order, unique together.

    Operators whose result hangs on order need one and raise ValueError without it. Conditions are Columns, SQL strings or
    callables that build a Column from fields (`lambda r: r.price > 3`); keys are Columns, paths or such callables. Plain
    Python functions go to consume(), or to map() with a schema. Rows that failed carry `_error`; see errors().
    """

    def __init__(self, df: DataFrame, order: list[str] | str | None = None):
        self.df = df
        self.order = [order] if isinstance(order, str) else list(order or [])

    def _with(self, df: DataFrame, order: list[str] | None = None) -> Flow:
        return Flow(df, self.order if order is None else order)

    def _need_order(self) -> list[str]:
        if not self.order:
            raise ValueError("this operator needs an order: give the flow order=[...] with keys that are unique together")
        return self.order

    def _rising(self) -> Flow:
        """This flow with an order of ascending keys alone: where a key goes down, the place of each row is the key."""
        if not any(isinstance(c, Down) for c in self._need_order()):
            return self
        name = self._fresh("_place")
        return Flow(with_index(self.df, self.order, name), [name])

    def _sorted(self, backwards: bool = False) -> DataFrame:
        return self.df.orderBy(*sort_columns(self._need_order(), backwards))

    def _cell(self, column: str | None) -> Column:
        """A column by name, or the record of all columns."""
        return F.col(f"`{column}`") if column else F.struct(*(F.col(f"`{c}`") for c in self.df.columns))

    def _column(self, what: Any) -> Column:
        return values.column_of(self.df, what)

    def _condition(self, what: Any) -> Column:
        column = values.condition_of(self.df, what)
        return values.truthy(column, values.type_of(self.df, column))

    # projections

    def map(self, fn: Any, wrap: bool = False, schema: str | None = None, name: str = "value") -> Flow:
        """One row for each. fn: a Column, an SQL expression, a dict of those by name, or a callable that builds one from fields.

        With a schema, fn is plain Python over a row as a dict, in Arrow batches, and what it raises becomes the row's
        error; an async function is awaited. wrap=True gives records (input, output). The order's columns stay.
        """
        if schema is not None:
            return self._with(tasks.concurrently(self.df, fn, schema))
        made = fn(values.Fields(self.df)) if callable(fn) and not isinstance(fn, Column) else fn
        made = made if isinstance(made, dict) else {name: made}
        made = {k: F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v) for k, v in made.items()}
        kept = [F.col(f"`{c}`") for c in self.order if c not in made]
        if wrap:
            output = next(iter(made.values())) if len(made) == 1 else F.struct(*(v.alias(k) for k, v in made.items()))
            record = F.struct(*(F.col(f"`{c}`") for c in self.df.columns if c not in self.order or len(self.df.columns) == len(self.order)))
            return self._with(self.df.select(*kept, record.alias("input"), output.alias("output")))
        return self._with(self.df.select(*kept, *(v.alias(k) for k, v in made.items())))

    def tap(self, name: str, *metrics: Column) -> Flow:
        """Pass all rows on; metrics are observed under a name when an action runs."""
        return self._with(self.df.observe(name, *(metrics or (F.count("*").alias("rows"),))))

    def pluck(self, path: str, default: Any = None, name: str = "value") -> Flow:
        """The value at a path, with a default where it is null or absent."""
        if not isinstance(path, str):
            raise TypeError(f"pluck needs a path, got {type(path).__name__}")
        found = values.path_column(self.df, path)
        found = found if default is None else F.coalesce(found, F.lit(default))
        return self._with(self.df.select(*(F.col(f"`{c}`") for c in self.order if c != name), found.alias(name)))

    def pick(self, fields: list[str]) -> Flow:
        """Only these columns, as far as they exist, and the order's."""
        return self._with(self.df.select(*(F.col(f"`{c}`") for c in self.df.columns if c in fields or c in self.order)))

    def omit(self, fields: list[str] | str) -> Flow:
        fields = [fields] if isinstance(fields, str) else fields
        return Flow(self.df.drop(*fields), self.order if not set(fields) & set(self.order) else [])

    # predicates

    def filter(self, condition: Condition) -> Flow:
        """Rows whose condition is true or truthy. A boolean condition reaches the scan as it is."""
        column = values.condition_of(self.df, condition)
        kind = values.type_of(self.df, column)
        return self._with(self.df.where(column if kind.typeName() == "boolean" else values.truthy(column, kind)))

    def reject(self, condition: Condition) -> Flow:
        """Rows whose condition is false, falsy or null."""
        return self._with(self.df.where(~self._condition(condition)))

    def async_filter(self, fn: Callable[[dict], Any], par: int = 1) -> Flow:
        """Rows for which an async (or plain) Python predicate gives something true; at most `par` at a time in a task."""
        kept = tasks.concurrently(self.df, fn, "_kept boolean", par, keep=True, change=bool)
        return self._with(kept.where(F.col("_kept") | (F.col(outcomes.ERROR).isNotNull())).drop("_kept"))

    def where(self, fields: dict[str, Any]) -> Flow:
        """Rows whose fields equal all of these, null equal to null."""
        out = F.lit(True)
        for k, v in fields.items():
            out = out & values.path_column(self.df, k).eqNullSafe(F.lit(v))
        return self._with(self.df.where(out))

    def find(self, condition: Condition) -> Flow:
        return self.filter(condition).take(1)

    def find_where(self, fields: dict[str, Any]) -> Flow:
        return self.where(fields).take(1)

    def compact(self, column: str = "value") -> Flow:
        """Rows whose column is not null, false, zero, NaN or empty."""
        return self._with(self.df.where(values.truthy(F.col(f"`{column}`"), self.df.schema[column].dataType)))

    def stop_when(self, condition: Condition) -> Flow:
        """Rows in order up to the first that meets the condition, with it."""
        rows = self._rising()
        return rows._with(grouping.until(rows.df, rows._condition(condition), rows.order))

    # shapes

    def flatten(self, column: str = "value") -> Flow:
        """A row for each item of an array, with its place appended to the order; null arrays stay as a null, empty ones vanish."""
        others = [F.col(f"`{c}`") for c in self.df.columns if c != column]
        array = F.coalesce(F.col(f"`{column}`"), F.array(F.lit(None)))
        place = "_at" if "_at" not in self.df.columns else next(n for i in itertools.count(1) if (n := f"_at{i}") not in self.df.columns)
        return self._with(self.df.select(*others, F.posexplode(array).alias(place, column)), [*self.order, place] if self.order else [])

    def flat_map(self, fn: Any, name: str = "value") -> Flow:
        """map() to an array, then flatten()."""
        return self.map(fn, name=name).flatten(name)

    def collect(self, column: str | None = None, name: str = "value") -> Flow:
        """One row with an array of all rows, or of a column, in order."""
        rows = self._rising()
        return Flow(grouping.collect_all(rows.df, rows.order, self._cell(column), name))

    def batch(self, size: float, column: str | None = None) -> Flow:
        """(batch, values): arrays of `size` neighbours."""
        rows = self._rising()
        return Flow(grouping.batches(rows.df, rows.order, size, self._cell(column)), ["batch"])

    # folds and groups

    def reduce(self, step: Callable[[Column, Column], Column], init: Any, column: str | None = None, by: list[str] | None = None, name: str = "value") -> Flow:
        """A left fold in order by a callable over Columns; always one row without `by`. For sums and the like, agg() is cheaper."""
        init = init if isinstance(init, Column) else F.lit(init)
        rows = self._rising()
        return Flow(grouping.fold(rows.df, rows.order, init, step, by, self._cell(column), name), by)

    def reduce1(self, step: Callable[[Column, Column], Column], column: str | None = None, by: list[str] | None = None, name: str = "value") -> Flow:
        rows = self._rising()
        return Flow(grouping.fold1(rows.df, rows.order, step, by, self._cell(column), name), by)

    def async_reduce(self, fn: Callable[[Any, dict], Any], init: Any, schema: str, by: list[str] | None = None) -> Flow:
        """A left fold by an async (or plain) Python function, one group at a time in a task; the result has the group's keys."""
        return Flow(tasks.folded(self.df, self._need_order(), fn, init, schema, by or []), by)

    def agg(self, *columns: Column, by: list[str] | None = None) -> Flow:
        """Aggregates that need no order, combined before the shuffle."""
        return Flow(self.df.groupBy(*(by or [])).agg(*columns), by)

    def group_by(self, key: Any, column: str | None = None) -> Flow:
        """(key, values): rows, or a column of them, in order by key; null keys are a group."""
        rows = self._rising()
        return Flow(grouping.groups(rows.df, rows._column(key), rows.order, self._cell(column)), ["key"])

    def key_by(self, key: Any, strict: bool = True) -> Flow:
        """(key, value): the row of each key; a key with several raises, or goes if not strict (see repeated_keys())."""
        return Flow(grouping.index_by(self.df, self._column(key), strict), ["key"])

    def repeated_keys(self, key: Any) -> Flow:
        return Flow(grouping.repeated_keys(self.df, self._column(key)), ["key"])

    def sorted_group_by(self, key: Any) -> Flow:
        """(run, key, values): neighbours of equal keys; a key that comes back is another run."""
        rows = self._rising()
        return Flow(grouping.runs(rows.df, rows._column(key), rows.order), ["run"])

    def uniq(self) -> Flow:
        """Different rows, by value; the order's columns don't count, and are dropped, unless they are all there is."""
        kept = [c for c in self.df.columns if c not in self.order] or self.df.columns
        return Flow(self.df.select(*(F.col(f"`{c}`") for c in kept)).distinct())

    def uniq_by(self, keys: Any) -> Flow:
        """The first row of each key, or of each tuple of several."""
        keys = keys if isinstance(keys, (list, tuple)) else [keys]
        rows = self._rising()
        return rows._with(grouping.first_of_each(rows.df, [rows._column(k) for k in keys], rows.order))

    # order and limits

    def _fresh(self, stem: str) -> str:
        return next(n for i in itertools.count() if (n := f"{stem}{i}") not in self.df.columns)

    def sort(self, column: str = "value", as_text: bool = False) -> Flow:
        """In order of a column, as text if as_text; the flow's order breaks ties."""
        key = F.col(f"`{column}`").cast("string") if as_text else F.col(f"`{column}`")
        name = self._fresh("_sort")
        return Flow(self.df.withColumn(name, key), [name, *self.order])

    def sort_by(self, *keys: Any) -> Flow:
        """In order of Columns, paths or callables that build a Column, of any type that has an order; (key, "desc") goes down.

        The flow's order breaks ties, so sort_by() after sort_by() sorts by the later, then the earlier. A single callable
        of two arguments compares two records (a Column below, at or above 0); such an order is made in one task.
        Sorted output: see values() and take().
        """
        if len(keys) == 1 and callable(keys[0]) and not isinstance(keys[0], Column) and keys[0].__code__.co_argcount == 2:
            rows, name = self._rising(), self._fresh("_by")
            record = F.struct(*(F.col(f"`{c}`") for c in rows.df.columns))
            given = grouping.collect_all(rows.df, rows.order, record).select(F.posexplode(F.array_sort("value", keys[0])).alias(name, "__r"))
            return Flow(given.select("__r.*", name), [name])
        made, names = self, []
        for k in keys:
            key, way = k if isinstance(k, tuple) else (k, "asc")
            if way not in ("asc", "desc"):
                raise ValueError(f"sort_by goes asc or desc, got {way!r}")
            name = made._fresh("_by")
            made = Flow(made.df.withColumn(name, self._column(key)), made.order)
            names.append(Down(name) if way == "desc" else name)
        return Flow(made.df, [*names, *self.order])

    def slice(self, start: float = 0, end: float | None = None) -> Flow:
        """Rows from place `start` to before `end`; start must be below end. slice(0) is the flow itself.

        With an end the first `end` rows are selected in each task and then among those; without one, rows are numbered by
        ranges of the order, so none of it sorts everything in one task.
        """
        for v in (start, end):
            if v is not None and not isinstance(v, (int, float)):
                raise TypeError(f"slice needs numbers, got {v!r}")
        if end is not None and start >= end:
            raise ValueError(f"slice needs start < end, got {start} and {end}")
        if start == 0 and end is None:
            return self
        if end is None:
            name = self._fresh("_at")
            return self._with(with_index(self.df, self._need_order(), name).where(F.col(name) >= int(start)).drop(name))
        rows = self._sorted().limit(int(end))
        return self._with(Flow(rows, self.order)._sorted().offset(int(start)) if start else rows)

    def take(self, n: int) -> Flow:
        return self.slice(0, n)

    def drop(self, n: int) -> Flow:
        return self.slice(n)

    def head(self) -> Flow:
        return self.take(1)

    def last(self) -> Flow:
        return self._with(self._sorted(backwards=True).limit(1))

    def with_index(self, name: str = "_index") -> Flow:
        return self._with(with_index(self.df, self._need_order(), name))

    # two flows and more

    def sorted_join(self, other: Flow, key: Any, other_key: Any = None, how: str = "inner", merge: bool = False, dir: str = "asc") -> Flow:
        """(key, a, b): pairs with equal keys, null equal to null; left and right keep rows without a partner.

        The inputs need no order. The result's is by key, up or down (dir), for values(), take() and the like.
        """
        if dir not in ("asc", "desc"):
            raise ValueError(f"sorted_join goes asc or desc, got {dir!r}")
        df = joins.keyed_join(self.df, other.df, self._column(key), other._column(other_key if other_key is not None else key), how, merge)
        return Flow(df, [Down("key") if dir == "desc" else "key"])

    def merge(self, *others: Flow, ordered: bool = False, par: int | None = None) -> Flow:
        """All rows of all flows; ordered=True puts this flow's rows first, then each other's, in their own orders.

        par bounds how many flows an in-memory stream reads at once; here the scheduler's free cores do, so it is only checked.
        """
        if not all(isinstance(o, Flow) for o in others):
            raise TypeError("merge() takes flows")
        if par is not None and par < 1:
            raise ValueError("par must be at least 1")
        df = joins.merged([self.df, *(o.df for o in others)], ordered)
        return Flow(df, ["_branch", *self.order] if ordered else self.order)

    def fork(self, keep: bool = False) -> Flow:
        """A flow over the same rows; keep=True caches them for several actions."""
        return self._with(self.df.persist() if keep else self.df)

    observe = fork

    def through(self, target: Any = None) -> Any:
        """Apply a pipeline, or a function of a flow or a DataFrame; None is the flow itself."""
        if target is None:
            return self
        if isinstance(target, Pipeline):
            return target(self)
        if isinstance(target, Flow):
            return target
        if not callable(target):
            raise TypeError("through() takes a pipeline, a flow or a function")
        out = target(self)
        return self._with(out) if isinstance(out, DataFrame) else out

    # text

    def split(self, column: str = "value") -> Flow:
        """A row for each line (ended by a line feed, with or without a return)."""
        return self._with(self.df.withColumn(column, text.pieces(F.col(f"`{column}`")))).flatten(column)

    def split_by(self, delimiter: Any, column: str = "value") -> Flow:
        """A row for each part between delimiters: a compiled pattern, or a literal string."""
        return self._with(self.df.withColumn(column, text.pieces(F.col(f"`{column}`"), delimiter))).flatten(column)

    def join_chunks(self, column: str = "value") -> Flow:
        """One row: chunks, cut anywhere, as one text."""
        rows = self._rising()
        return Flow(text.joined_chunks(rows.df, rows.order, column))

    def digest(self, column: str = "value", algorithm: str = "md5") -> Flow:
        """One row: the hex digest of chunks, cut anywhere, as one text; they are streamed, so the text may be of any length."""
        rows = self._rising()
        return Flow(text.digest(rows.df, rows.order, column, algorithm))

    def _base64(self, encoding: str, column: str, across: bool, size: int, change: Callable[[Column], Column]) -> Flow:
        if encoding != "base64":
            raise ValueError(f"unknown encoding {encoding}")
        if not across:
            return self._with(self.df.withColumn(column, change(F.col(f"`{column}`"))))
        rows = self._rising()
        return Flow(text.across_chunks(rows.df, rows.order, column, POSITION, size, change), [RANGE, POSITION])

    def encode(self, encoding: str = "base64", column: str = "value", across: bool = False) -> Flow:
        """Base64 of each row's text or bytes; across=True takes the rows as chunks of one string, cut anywhere, and keeps nothing but them."""
        return self._base64(encoding, column, across, 3, text.to_base64)

    def decode(self, encoding: str = "base64", column: str = "value", across: bool = False) -> Flow:
        """The bytes of each row's base64, null for what is none; across=True takes the rows as chunks of one text, cut anywhere, without white space."""
        return self._base64(encoding, column, across, 4, lambda c: text.from_base64(c.cast("string")))

    def csv(self, header: bool | list[str] | Callable = False, column: str = "value", width: int | None = None, quote: str = '"', escape: str = '"', separator: str = ",", encoding: str = "utf8", fast_mode: bool = False) -> Flow:
        """Rows of CSV text. header: True (the first row names the columns), names, or a function of the first row; False needs a width.

        The chunks of the flow, text or bytes cut anywhere, are one text in order; its records end at line feeds and returns
        outside quotes. fast_mode: no quotes, and a line feed ends a record always. An escape before a quote or another
        escape stands for that. The first row reaches the driver if it names the columns.
        """
        chunks = self._rising()
        rows = text.csv_rows(chunks.df, chunks.order, column, POSITION, quote, escape, encoding, fast_mode)
        if isinstance(header, (list, tuple)):
            names = list(header)
        elif header:
            first = rows.orderBy(POSITION).limit(1).select(POSITION, text.csv_cells(F.col(column), separator, quote, escape, fast_mode).alias("names")).first()
            names = list(first.names) if first else []
            names = list(header(names)) if callable(header) else names
            rows = rows.where(F.col(POSITION) > (first[POSITION] if first else -1))
        else:
            if width is None:
                raise ValueError("csv without a header needs a width")
            names = [f"c{i}" for i in range(width)]
        return Flow(text.parse_csv(rows, column, names, separator, quote, escape, fast_mode), [POSITION])

    def csv_stringify(self, columns: list[str] | None = None, header: bool | list[str | None] = False, name: str = "value", **how) -> Flow:
        """A line of CSV text for each row; header=True puts a line of names first, if there are rows.

        header may be a list: of columns to write, or else names for the columns by place, of which a None leaves its column out.
        how: quote, escape, separator, line_ending, quoted, quoted_empty; encoding (other than utf8: lines are bytes).
        """
        columns = columns or [c for c in self.df.columns if c not in self.order] or self.df.columns
        names = columns
        if isinstance(header, (list, tuple)):
            if set(header) <= set(columns):
                columns = names = list(header)
            else:
                pairs = [(c, h) for c, h in zip(columns, header) if h is not None]
                columns, names = [c for c, _ in pairs], [h for _, h in pairs]
        rows = self.df.select(*(F.col(f"`{c}`") for c in self.order), text.csv_line(self.df, columns, **how).alias(name))
        if not header:
            return self._with(rows)
        titles = self.df.limit(1).select(*(F.lit(h).alias(f"h{i}") for i, h in enumerate(names)))
        first = titles.select(*(F.lit(None).cast(self.df.schema[c].dataType).alias(c) for c in self.order), text.csv_line(titles, titles.columns, **how).alias(name))
        return Flow(joins.merged([first, rows], ordered=True), ["_branch", *self.order])

    # errors

    def attempt(self, name: str, tried: Column, source: Any, message: str) -> Flow:
        """A column by a try_ expression; rows where it fails become errors."""
        return self._with(outcomes.attempt(self.df, name, tried, self._column(source), message))

    def errors(self, handler: Any = None) -> Flow:
        """Rows that are no errors, and what a handler makes of the others: None drops them; a dict of columns, or a function of the
        error rows' DataFrame, replaces them; "raise" raises the first when it is read."""
        df = self.df
        if outcomes.ERROR not in df.columns:
            return self
        if handler == "raise":
            return self._with(df.where(F.when(F.col(outcomes.ERROR).isNotNull(), F.raise_error(F.col(f"{outcomes.ERROR}.message")).cast("boolean")).otherwise(True)).drop(outcomes.ERROR))
        good, failed = outcomes.good(df), df.where(F.col(outcomes.ERROR).isNotNull())
        if handler is None:
            return self._with(good)
        made = handler(failed) if callable(handler) else failed.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in handler.items()})
        return self._with(good.unionByName(made.select(*(F.col(f"`{c}`") for c in good.columns))))

    def failed(self) -> Flow:
        """(message, type, input) of the rows that are errors."""
        return Flow(outcomes.bad(self.df))

    def stop_on_error(self, replacement: dict[str, Any] | None = None) -> Flow:
        """Rows in order before the first error, and a replacement for that one."""
        if outcomes.ERROR not in self.df.columns:
            return self
        stop = F.col(outcomes.ERROR).isNotNull()
        rows = self._rising()
        return rows._with(grouping.until(rows.df, stop, rows.order, inclusive=replacement is not None)).errors(replacement)

    # time and concurrency

    def throttle(self, ms: float, time: str, by: list[str] | None = None) -> Flow:
        """At most one row in `ms` of event time in each group, the first ones."""
        rows = self._rising()
        return rows._with(grouping.spaced(rows.df, by or [], time, rows.order, ms / 1000))

    def ratelimit(self, num: int, ms: int, name: str = "release_ms") -> Flow:
        """The time after the start at which each row is let go, `num` in each `ms`. Streams: see streaming.limited()."""
        return self._with(grouping.release_slots(self.df, self._need_order(), num, ms, name))

    def resolve(self, fn: Callable[[dict], Any], schema: str, par: int = 1, preserve_order: bool = True) -> Flow:
        """Columns of what an async (or plain) function gives for each row, at most `par` at a time in a task; what it raises is the row's error."""
        return self._with(tasks.concurrently(self.df, fn, schema, par, keep=True, in_order=preserve_order))

    def mass_then(self, fn: Callable[[dict], Any], schema: str) -> Flow:
        """fn, async or plain, over the rows that are no errors; what it gives is awaited, what it raises is the row's error."""
        return self._with(tasks.concurrently(self.df, fn, schema))

    def mass_catch(self, handler: Any) -> Flow:
        return self.errors(handler)

    def make_async(self, ms: int = 0) -> Flow:
        """The flow itself: Spark's scheduler yields by tasks."""
        return self

    def consume(self, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, by: list[str] | None = None) -> Flow:
        """The extension point: a Python generator over rows as dicts, of each partition, or in order of each group."""
        return Flow(tasks.consumed(self.df, fn, schema, by, self.order), [c for c in self.order if c in schema])

    consume_sync = consume

    def start(self) -> Flow:
        return self

    pause = resume = start

    def end(self) -> None:
        """Release what fork(keep=True) holds."""
        self.df.unpersist()

    destroy = end

    # terminals

    def values(self) -> list[Row]:
        """All rows on the driver, in order if the flow has one. An error among them raises."""
        rows = self.errors("raise")
        return (rows._sorted() if self.order else rows.df).collect()

    def value(self) -> Row | None:
        """The only row; None if there is none, ValueError if there are more."""
        found = self.errors("raise").df.limit(2).collect()
        if len(found) > 1:
            raise ValueError("the flow has more than one value")
        return found[0] if found else None

    def each(self, fn: Callable[[Row], None]) -> None:
        """fn over each row, on the executors."""
        self.errors("raise").df.foreach(fn)

    def pull(self) -> Iterator[Row]:
        """Rows on demand, a partition at a time."""
        rows = self.errors("raise")
        return (rows._sorted() if self.order else rows.df).toLocalIterator(prefetchPartitions=True)

    to_iterator = to_node_stream = pull

    async def to_async_iterator(self):
        for row in self.pull():
            yield row
            await asyncio.sleep(0)

    def to_array(self, done: Callable[[list[Row]], Any]) -> Any:
        return done(self.values())

    def to_promise(self) -> Future:
        """A Future of values(), with its exception if it fails."""
        out: Future = Future()
        try:
            out.set_result(self.values())
        except Exception as e:  # noqa: BLE001  the future carries it
            out.set_exception(e)
        return out

    def pipe(self, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
        """Write to any Spark sink; text needs one string column."""
        self.errors("raise").df.write.format(format).mode(mode).options(**options).save(path)


def extend(name: str, fn: Callable) -> None:
    """Add a method to all flows; pipelines record it too."""
    setattr(Flow, name, fn)


class _DataLast:
    """fn.filter(cond)(flow): every method with the flow given last."""

    def __getattr__(self, method: str) -> Callable:
        return lambda *args, **more: lambda source: getattr(source, method)(*args, **more)


fn = _DataLast()


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


for _name in [n for n in vars(Flow) if "_" in n and not n.startswith("_")]:
    setattr(Flow, _camel(_name), getattr(Flow, _name))
