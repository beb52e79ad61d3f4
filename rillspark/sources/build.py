"""What a flow can begin with: records, generators, awaitables, files, and recursive queries."""

from __future__ import annotations

import asyncio
import base64
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillspark.functions.values import is_async_iterable, is_iterable, is_promise, is_string

POSITION = "_pos"


class END:
    """What a generator writes when it is done: this class itself, which pickles by name."""


INVALID = "A flow can begin with records, a DataFrame, an (async) iterable, an awaitable or a generator function"


def records_frame(spark: SparkSession, items: list, schema: str | None = None) -> DataFrame:
    """Items in order with their position: dicts and tuples of a schema as records, others in column `value`."""
    if schema is None:
        if not items:
            return spark.createDataFrame([], f"{POSITION} bigint, value string")
        if isinstance(items[0], dict):
            names = list(dict.fromkeys(k for r in items for k in r))
            return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(items)], [POSITION, *names])
        return spark.createDataFrame([(i, x) for i, x in enumerate(items)], [POSITION, "value"])
    fields = T.StructType.fromDDL(schema)
    rows = [tuple(r.get(n) for n in fields.names) if isinstance(r, dict) else tuple(r) if isinstance(r, (tuple, list)) and len(fields) > 1 else (r,) for r in items]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField(POSITION, T.LongType()), *fields.fields]))


async def _gathered(items: Any) -> list:
    return [x async for x in items]


def driver_items(xs: Any) -> list:
    """Items of an iterable, async iterable or awaitable, which one process makes in any case."""
    if is_async_iterable(xs):
        return asyncio.run(_gathered(xs))
    if is_promise(xs):
        async def one() -> Any:
            return await xs
        return [asyncio.run(one())]
    return list(xs)


def pulled(source: Any, limit: int | None = None) -> Iterator[Any]:
    """The items of a generator function fn(write, next), called again as long as it calls next().

    next(other) goes on with another generator function or an iterable in its place, however deep; write(END) ends.
    """
    n = 0
    while source is not None:
        if not callable(source):
            for x in source:
                yield x
                n += 1
                if limit is not None and n >= limit:
                    return
            return
        written: list = []
        after: list = []
        source(written.append, lambda other=None: after.append(other))
        for x in written:
            if x is END:
                return
            yield x
            n += 1
            if limit is not None and n >= limit:
                return
        if not after:
            return
        source = after[0] if after[0] is not None else source


class GeneratorSource(DataSource):
    """spark.read.format("rill_generator"): a pickled generator function, run by one task; its exceptions fail the read."""

    @classmethod
    def name(cls) -> str:
        return "rill_generator"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GeneratorReader(self.options["code"], len(schema) - 1, int(self.options.get("limit", "-1")))


class _GeneratorReader(DataSourceReader):
    def __init__(self, code: str, width: int, limit: int):
        self.code, self.width, self.limit = code, width, limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = cloudpickle.loads(base64.b64decode(self.code))
        for i, x in enumerate(pulled(source, None if self.limit < 0 else self.limit)):
            if isinstance(x, BaseException):
                raise x
            yield (i, *x) if self.width > 1 else (i, x)


def generated_frame(spark: SparkSession, fn: Callable, schema: str, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(GeneratorSource)
    code = base64.b64encode(cloudpickle.dumps(fn)).decode()
    reader = spark.read.format("rill_generator").option("schema", f"{POSITION} bigint, {schema}").option("code", code)
    return reader.option("limit", str(-1 if limit is None else limit)).load()


def recursive_frame(spark: SparkSession, columns: str, seed: str, step: str, name: str = "r") -> DataFrame:
    """A recursive query: rows of `seed`, then of `step`, SQL that reads the last rows as table `name`, until it gives none."""
    return spark.sql(f"WITH RECURSIVE {name}({columns}) AS (SELECT {seed} UNION ALL SELECT {step}) SELECT * FROM {name}")


def frame_of(spark: SparkSession, xs: Any, schema: str | None = None, limit: int | None = None) -> DataFrame:
    if isinstance(xs, DataFrame):
        return xs
    if callable(xs) and not is_iterable(xs) and not is_promise(xs) and not is_async_iterable(xs):
        return generated_frame(spark, xs, schema or "value bigint", limit)
    if is_string(xs) or not (is_iterable(xs) or is_promise(xs) or is_async_iterable(xs)):
        raise TypeError(INVALID)
    return records_frame(spark, driver_items(xs), schema)


def read_lines(spark: SparkSession, path: str, delimiter: Any = None) -> DataFrame:
    """(path, _at, value): the lines of text files in order, or the parts between delimiters; .gz files are unpacked. The order is path, _at.

    Without a delimiter a file is read whole in a task, as its order asks; many files are many tasks.
    """
    from rillspark.functions.text import LINES, pieces

    parts = pieces(F.col("value"), delimiter if delimiter is not None else re.compile(LINES))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(parts).alias("_at", "value"))


def read_bytes(spark: SparkSession, path: str, unpack: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """(path, _at, value binary): files as chunks of bytes in order; unpack takes gzip apart as it goes. The order is path, _at."""
    import zlib

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("_at", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns)):
                at, gunzip = 0, zlib.decompressobj(wbits=31)
                while content:
                    if unpack:
                        piece = gunzip.decompress(content, chunk)
                        content = gunzip.unconsumed_tail
                        if gunzip.eof:  # the next member of the file, if any
                            content, gunzip = gunzip.unused_data, zlib.decompressobj(wbits=31)
                    else:
                        piece, content = content[:chunk], content[chunk:]
                    if piece:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([piece], pa.binary())], schema=schema)
                        at += 1

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, _at bigint, value binary")
