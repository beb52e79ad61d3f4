"""The operators over Structured Streaming: sources and sinks, fan-out, event-time windows, de-duplication, throttling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files: int | None = None, time: str | None = None, late: str = "0 seconds", pattern: str | None = None) -> DataFrame:
    """A stream over a folder's files; `files` a trigger limits its rate. time: a column to make a timestamp with a watermark of `late`."""
    reader = spark.readStream.format(format).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    out = reader.load(path)
    return out.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if time else out


class PushedStream:
    """A stream that is pushed into: each write() is a file of rows below `place`, a shared folder; frame() streams them; after end() writing is refused."""

    def __init__(self, spark: SparkSession, schema: str, place: str):
        self._spark, self._schema, self._place, self._ended = spark, T.StructType.fromDDL(schema), f"{place}/pushed", False
        spark.createDataFrame([], self._schema).write.mode("ignore").parquet(self._place)

    def write(self, *rows: Any) -> PushedStream:
        if self._ended:
            raise ValueError("write after end")
        records = [tuple(r.get(n) for n in self._schema.names) if isinstance(r, dict) else r if isinstance(r, (tuple, list)) else (r,) for r in rows]
        self._spark.createDataFrame(records, self._schema).coalesce(1).write.mode("append").parquet(self._place)
        return self

    def end(self) -> None:
        self._ended = True

    def frame(self, files: int | None = None, time: str | None = None, late: str = "0 seconds") -> DataFrame:
        return stream_of(self._spark, self._place, self._schema, files=files, time=time, late=late)


def run_available(df: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet files below `place`, a shared folder of its own, and read them.

    complete: each micro-batch replaces the files of the one before.
    """
    out = f"{place}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def write_available(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> None:
    """Run a stream over all that is there now into files; a run after a failure goes on from its checkpoint, exactly once."""
    df.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Give each micro-batch to several sinks, reading it once."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for sink in sinks:
            sink(held, number)
        held.unpersist()

    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def limited(spark: SparkSession, path: str, schema: T.StructType | str, files: int, every: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Rate limiting of a stream: at most `files` files each `every` (a trigger interval) go to the sink; the query runs on."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def uniq_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; state is kept as long as the watermark lets a repeat come."""
    return df.dropDuplicatesWithinWatermark(keys)


def windows(df: DataFrame, time: str, width: str, *aggregates: Column, by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of event time."""
    return df.groupBy(F.window(time, width, slide), *(by or [])).agg(*aggregates)


def throttle_stream(df: DataFrame, by: list[str], time: str, seconds: float) -> DataFrame:
    """Leading-edge sampling in each group with the last kept time as state; df has a watermark on `time`, a timestamp.

    Rows of a micro-batch are put in time order; rows that come in a later batch with an earlier time are dropped like those
    that are too close. A group's state goes once the watermark is `seconds` beyond it: whatever comes then is far enough.
    """
    kind = df.schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        kept = []
        for i, t in enumerate(rows[time].astype("datetime64[us]" if rows[time].dt.tz is None else "datetime64[us, UTC]").astype("int64")):
            if last is None or t - last >= seconds * 1e6:
                kept.append(i)
                last = int(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept]

    return df.groupBy(*by).applyInPandasWithState(run, kind, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


class Events(StreamingQueryListener):
    """What happens to streams, for handlers by name: start, data (a micro-batch with rows), drain (one without), end, error.

    A handler gets the query's name, or its id, and what there is to say: the progress, or the error's message. Handlers of
    `error` are called before those of `end`; without any, an error is left to awaitTermination().
    """

    NAMES = ("start", "data", "drain", "end", "error")

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable]] = {n: [] for n in self.NAMES}
        self.names: dict[str, str] = {}

    def on(self, event: str, handler: Callable[[str, Any], None]) -> Events:
        self.handlers[event].append(handler)
        return self

    def _say(self, event: str, query: str, what: Any = None) -> None:
        for handler in self.handlers[event]:
            handler(query, what)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name or str(event.id)
        self._say("start", self.names[str(event.id)])

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._say("data" if p.numInputRows else "drain", p.name or str(p.id), p)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._say("drain", self.names.get(str(event.id), str(event.id)))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        name = self.names.pop(str(event.id), str(event.id))
        if event.exception:
            self._say("error", name, event.exception)
        self._say("end", name)
