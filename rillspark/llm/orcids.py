"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.llm.common import arrow_schema, gathered, map_arrow, picked, shuffle_cleanup
from rillspark.llm.vocab import TOGETHER, encoder, vocabulary

#: Ids of one row at most, so that a very long document is several rows and writers and readers hold little.
PIECE_IDS = 1 << 16
STRIPE_BYTES, INDEX_ROWS, WRITE_ROWS, READ_ROWS = 16 << 20, 1000, 128, 256


def write_ids(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, piece_ids: int = PIECE_IDS, specials: bool = True) -> None:
    """Encode every text, append end_id, and write the ids as ORC files to folder `to`, in ascending order of document id.

    Rows: doc_id, shard, doc_at, piece, pieces, n_tokens (of the piece), ids. shard numbers the files in id order; doc_at
    is the count of ids in the shard before the document. Texts are dealt by range of (id, hash of the text), so equal ids
    spread as well; null ids come first; null and empty texts have end_id alone; equal ids go by text hash, then text.
    Strings of special tokens become their ids, as in the library's plain call; specials=False takes them as text.
    """
    path = path or vocabulary()
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("h", F.xxhash64("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, shard int, doc_at bigint, piece int, pieces int, n_tokens bigint, ids array<int>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, shard, at = encoder(path, specials), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for b in gathered(batches, TOGETHER):
            cols: list[list] = [[] for _ in range(6)]
            data = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                cuts = range(0, len(ids), piece_ids * 4)
                for i, c in enumerate(cuts):
                    data.append(ids[c : c + piece_ids * 4])
                    for col, v in zip(cols, (doc_id, shard, at, i, len(cuts), len(data[-1]) // 4)):
                        col.append(v)
                at += len(ids) // 4
            ends = np.cumsum([0, *cols[5]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4"))).cast(schema.field("ids").type)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(cols)), lists], schema=schema)

    ranged = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    options = {
        "orc.compress": "ZSTD", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.row.batch.size": WRITE_ROWS,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    }
    with shuffle_cleanup(docs.sparkSession):
        map_arrow(ranged, run, ddl).write.options(**{k: str(v) for k, v in options.items()}).orc(to)


def read_ids(spark: SparkSession, at: str, where: Column | str | None = None) -> DataFrame:
    """The rows of write_ids(); `where` on doc_id prunes files, stripes and row groups by their metadata and Bloom filters."""
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", str(READ_ROWS))
    rows = spark.read.orc(at)
    return rows if where is None else rows.where(where)


def _joined_crc(a: int, b: int, length: int) -> int:
    """The CRC-32 of two strings one after the other, from theirs and the second's length."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    shift = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        shift = [times(shift, c) for c in shift]
    while length:
        if length & 1:
            a = times(shift, a)
        shift = [times(shift, c) for c in shift]
        length >>= 1
    return a ^ b


def documents_of(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of read_ids().

    start counts the ids of all documents before it: the totals of the shards, one small row each, are summed in shard
    order and added to doc_at. CRCs of pieces are taken where the ids are read and joined for documents of several pieces.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, shard int, doc_at bigint, piece int, n_tokens bigint, crc bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(5)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(crcs, pa.int64())], schema=schema)

    pieces = map_arrow(rows.select("doc_id", "shard", "doc_at", "piece", "n_tokens", "ids"), run, ddl)
    whole = pieces.groupBy("shard", "doc_at").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n_tokens", "crc"))).alias("parts"))

    final = f"shard int, doc_at bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint"
    final_schema = arrow_schema(final)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(4)
            at, (n, crc) = parts.offsets.to_numpy(), (parts.values.field(i).to_numpy() for i in (1, 2))
            out = crc[at[:-1]].copy()
            for i in np.nonzero(np.diff(at) > 1)[0]:
                for j in range(at[i] + 1, at[i + 1]):
                    out[i] = _joined_crc(int(out[i]), int(crc[j]), int(n[j]) * 4)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], schema=final_schema)

    joined = map_arrow(whole.select("shard", "doc_at", "doc_id", "n_tokens", "parts"), join, final)
    each = rows.select("shard", "n_tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.select("shard", before.alias("shard_at"))
    return joined.join(offsets, "shard").select("doc_id", (F.col("doc_at") + F.col("shard_at")).alias("start"), "n_tokens", "ids_crc32")
