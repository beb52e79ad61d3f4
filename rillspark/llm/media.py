"""Media columns: payloads as ordered lists of content-defined chunks, each different chunk stored once.

A rolling gear hash cuts a payload where its bytes say so, so equal passages give equal chunks wherever they stand. The
store keeps one compressed row (bzip2, which suits short texts) for each chunk digest; a recipe lists a payload's digests in order. Reading back joins
recipes to the store and takes a payload's chunks in order, one at a time.
"""

from __future__ import annotations

import bz2
import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import arrow_schema, cut, map_arrow, picked

UNIT = 64


@dataclass(frozen=True)
class Cutter:
    """Cut after a byte where the top `bits` bits of the gear hash are 0, at least `least` and at most `most` bytes apart."""

    least: int = 2048
    bits: int = 13
    most: int = 65536

    def ends(self, data: bytes) -> list[int]:
        if len(data) <= self.least:
            return [len(data)]
        h = _gear()[np.frombuffer(data, np.uint8)]
        for k in (1, 2, 4, 8, 16):  # h[i]: the sum of gear[data[i - j]] << j over the last 2k bytes
            h[k:] += h[:-k] << np.uint32(k)
        found, at = [], 0
        for end in (np.nonzero(h >> np.uint32(32 - self.bits) == 0)[0] + 1).tolist():
            while end - at > self.most:
                at += self.most
                found.append(at)
            if end - at >= self.least and end < len(data):
                at = end
                found.append(at)
        while len(data) - at > self.most:
            at += self.most
            found.append(at)
        return [*found, len(data)]


@functools.cache
def _gear() -> np.ndarray:
    """A number for each byte value, by a mixing rule."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


@dataclass
class Stored:
    """recipes: (doc_id, n_bytes, payload_bytes, sha256, recipe, digests), a row for each input row. store: (digest, data, whole, part), a row for each different chunk."""

    recipes: DataFrame
    store: DataFrame


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutter: Cutter | None = None) -> Stored:
    """Write both tables to the shared folder.

    Null texts are empty; an empty payload is 64 zero bytes. whole and part tell whether some payload is this chunk alone,
    and whether some payload has it among others. Chunks of equal digest meet in a partial aggregate before the shuffle.
    """
    cutter = cutter or Cutter()
    rows = picked(docs, doc_id=id_col, text=text_col)
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, sha256 string, recipe string, digests array<binary>"
    listed, chunk_ddl = arrow_schema(ddl), "digest binary, data binary, whole boolean, part boolean"
    chunked = arrow_schema(chunk_ddl)

    def cut_up(text: str | None) -> tuple[int, bytes, list[bytes]]:
        n, data = payload(text)
        ends = cutter.ends(data)
        return n, data, [data[a:z] for a, z in zip([0, *ends], ends)]

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                n, data, chunks = cut_up(text)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                for c, v in zip(out, (n, len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(b"".join(digests)).hexdigest(), digests)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(listed)[1:]))], schema=listed)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[bytes, list] = {}
            for text in b.column(0).to_pylist():
                _, _, parts = cut_up(text)
                for c in parts:
                    digest = hashlib.sha256(c).digest()
                    if digest not in made:
                        made[digest] = [digest, bz2.compress(c), False, False]
                    made[digest][2 if len(parts) == 1 else 3] = True
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made.values()), chunked)], schema=chunked)

    every = map_arrow(rows.select("text"), chunks, chunk_ddl)
    once = every.groupBy("digest").agg(F.first("data").alias("data"), F.max("whole").alias("whole"), F.max("part").alias("part"))
    return Stored(cut(map_arrow(rows, recipes, ddl), "recipes"), cut(once, "chunks"))


class _Reading:
    """What is computed of one payload while its stored chunks pass in order."""

    def __init__(self) -> None:
        self.n = self.media = self.chunks = 0
        self.sha, self.media_sha, self.tail, self.counts = hashlib.sha256(), hashlib.sha256(), b"", np.zeros(256, np.int64)

    def add(self, stored: bytes, chunk: bytes) -> None:
        self.n, self.media, self.chunks = self.n + len(chunk), self.media + len(stored), self.chunks + 1
        self.sha.update(chunk)
        self.media_sha.update(stored)
        self.tail = (self.tail + chunk[-UNIT:])[-UNIT:]
        self.counts += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)

    def row(self, recipe: str) -> tuple:
        p = self.counts[self.counts > 0] / self.n
        feature = f"chunks={self.chunks};symbols={len(p)};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"
        return recipe, self.n, self.sha.hexdigest(), zlib.crc32(self.tail), self.media, self.media_sha.hexdigest(), feature


_FEATURES = "recipe string, n bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(stored: Stored) -> DataFrame:
    """A row for each different payload, computed from the stored chunks alone; see _Reading.

    Payloads of one chunk need no join: a scan of the store has their bytes. Only chunks of longer payloads are dealt, by
    digest to meet the recipes (a chunk that many share is a hot key on the recipes' side, which AQE splits), and then by
    payload, where a task holds one chunk at a time.
    """
    schema = arrow_schema(_FEATURES)

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, data in zip(*(c.to_pylist() for c in b.columns)):
                one = _Reading()
                one.add(data, bz2.decompress(data))
                rows.append(one.row(hashlib.sha256(digest).hexdigest()))
            yield from out(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recipe, now = None, None
        for b in itertools.chain(batches, [None]):
            rows = []
            for key, data in zip(*(c.to_pylist() for c in b.columns)) if b is not None else ():
                if key != recipe:
                    if now is not None:
                        rows.append(now.row(recipe))
                    recipe, now = key, _Reading()
                now.add(data, bz2.decompress(data))
            if b is None and now is not None:
                rows.append(now.row(recipe))
            yield from out(rows)

    single = map_arrow(stored.store.where("whole").select("digest", "data"), alone, _FEATURES)
    listed = stored.recipes.where(F.size("digests") > 1).dropDuplicates(["recipe"]).select("recipe", F.posexplode("digests").alias("at", "digest"))
    dealt = listed.join(stored.store.where("part").select("digest", "data"), "digest")
    several = map_arrow(dealt.repartition("recipe").sortWithinPartitions("recipe", "at").select("recipe", "data"), joined, _FEATURES)
    return single.union(several)


def read_back(stored: Stored) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, verified) for each input row.

    verified: the bytes read back have the length and SHA-256 of the payload that was written. media is the stored form:
    the compressed chunks in order. Equal texts have equal values.
    """
    found = features(stored)
    rows = stored.recipes.drop("digests").join(found, "recipe", "left")
    right = F.coalesce((F.col("n") == F.col("payload_bytes")) & (F.col("sha256") == F.col("payload_sha256")), F.lit(False))
    return rows.select("doc_id", "n_bytes", F.col("n").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", right.alias("verified"))


def payloads(stored: Stored) -> DataFrame:
    """(doc_id, payload binary): the media themselves, a row for each input row, for payloads that fit a row. Null and empty texts are 64 zero bytes; repeated rows and null ids stay."""
    listed = stored.recipes.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode("digests").alias("at", "digest"))
    ddl = "doc_id {}, payload binary".format(stored.recipes.schema["doc_id"].dataType.simpleString())
    schema = arrow_schema(ddl)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, parts = None, None, []
        for row, doc_id, data in itertools.chain((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))), [(None, None, None)]):
            if row != now and now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([doc], schema[0].type), pa.array([b"".join(parts)], pa.binary())], schema=schema)
                parts = []
            now, doc = row, doc_id
            if row is not None:
                parts.append(bz2.decompress(data))

    dealt = cut(listed, "listed").join(stored.store.select("digest", "data"), "digest")
    return map_arrow(dealt.repartition("row").sortWithinPartitions("row", "at").select("row", "doc_id", "data"), joined, ddl)
