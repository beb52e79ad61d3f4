"""Python work inside tasks: bounded concurrency, ordered folds and free generators over rows."""

from __future__ import annotations

import asyncio
import inspect
import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.operators.outcomes import ERROR, ERROR_TYPE
from rillspark.plans.index import sort_columns


#: Rows of one Arrow batch that goes back.
ROWS = 1000


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as they are: whole numbers stay whole beside nulls, and nulls are None."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


async def _settled(given: Any) -> Any:
    return await given if inspect.isawaitable(given) else given


def concurrently(df: DataFrame, fn: Callable[[dict], Any], schema: str, par: int = 1, keep: bool = True, in_order: bool = True, change: Callable[[Any], Any] | None = None) -> DataFrame:
    """Columns of fn's results, with at most `par` calls of a task in flight; what it raises or gives as an exception is the row's error.

    fn gives a dict, or a value for a schema of one column, or an awaitable of those. in_order=False lets rows go as their
    calls end. Rows that are errors already pass. keep=True keeps the input's columns.
    """
    if par < 1:
        raise ValueError("par must be at least 1")
    made = T.StructType.fromDDL(schema)
    kept = [f for f in (df.schema.fields if keep else []) if f.name != ERROR and f.name not in made.names]
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in [*kept, *made.fields]] + [T.StructField(ERROR, ERROR_TYPE)])
    sent = _arrow(kind)

    def failed(e: Exception, record: dict) -> dict:
        return {"message": str(e), "type": type(e).__name__, "input": repr(record)}

    def fitted(rows: list[dict]) -> Iterator[dict]:
        """Rows as they are, but for those whose values don't fit the schema: they are errors too."""
        for r in rows:
            try:
                _batch([r], sent)
                yield r
            except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                yield {**r, **dict.fromkeys(made.names), ERROR: failed(e, {k: v for k, v in r.items() if k != ERROR})}

    async def settle(records: list[dict]) -> list[dict]:
        gate, out = asyncio.Semaphore(par), []

        async def one(at: int, record: dict) -> None:
            error, found = record.pop(ERROR, None), {}
            if error is None:
                try:
                    async with gate:
                        given = await _settled(fn(dict(record)))
                    if isinstance(given, BaseException):
                        raise given
                    given = change(given) if change else given
                    found = given if isinstance(given, dict) else {made.names[0]: given}
                except Exception as e:  # noqa: BLE001  the error is data here
                    error, found = failed(e, record), {}
            out.append((at, {**(record if keep else {}), **dict.fromkeys(made.names), **found, ERROR: error}))

        await asyncio.gather(*(one(i, r) for i, r in enumerate(records)))
        return [r for _, r in (sorted(out, key=lambda p: p[0]) if in_order else out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = asyncio.run(settle(batch.to_pylist()))
            try:
                out = _batch(rows, sent)
            except (pa.ArrowException, TypeError, ValueError, OverflowError):
                out = _batch(list(fitted(rows)), sent)
            yield out

    return df.mapInArrow(run, kind)


def consumed(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, by: list[str] | None, order: list[str]) -> DataFrame:
    """What a generator yields for the rows of each partition, or, with keys, for the rows of each key in order, streamed."""
    kind = T.StructType.fromDDL(schema)
    sent = _arrow(kind)

    def chunks(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(rows, ROWS)):
            yield _batch(some, sent)

    if not by:
        return df.mapInArrow(lambda batches: chunks(iter(fn(_rows_of(batches)))), kind)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (x for _, own in itertools.groupby(_rows_of(batches), key=lambda r: tuple(r[c] for c in by)) for x in fn(own))
        yield from chunks(made)

    return df.repartition(*by).sortWithinPartitions(*by, *sort_columns(order)).mapInArrow(grouped, kind)


def folded(df: DataFrame, order: list[str], fn: Callable[[Any, dict], Any], init: Any, schema: str, by: list[str]) -> DataFrame:
    """A left fold by a Python function over the rows of each key in order, one row at a time."""
    kind = T.StructType.fromDDL(schema)

    def each(rows: Iterator[dict]) -> Iterator[dict]:
        async def all_of() -> tuple[dict, Any]:
            memo, first = init, {}
            for row in rows:
                first = first or row
                memo = await _settled(fn(memo, row))
            return first, memo

        first, memo = asyncio.run(all_of())
        yield {**{c: first.get(c) for c in by}, **(memo if isinstance(memo, dict) else {kind.names[0]: memo})}

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    full = f"{keys}, {schema}" if by else schema
    rows = df if by else df.withColumn("__all", F.lit(1))
    return consumed(rows, each, full, by or ["__all"], order)
