"""Hierarchical packing of tokenised documents into context windows of several lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillspark.llm.common import arrow_schema, gathered, map_arrow, picked
from rillspark.llm.vocab import TOGETHER, encoder, vocabulary

#: Tokens that a task holds before it packs them. What is left of a round goes into the next.
HELD_TOKENS = 4 << 20
#: Tokens of a step group: sequences of one length that are trained together.
STEP_TOKENS = 1 << 16


class Tier:
    """Pieces that wait in one length tier, sorted by length; equal lengths go in order of arrival."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[int, tuple[int, int, int]] = {}
        self.tokens = self.next = 0

    def add(self, piece: tuple[int, int, int]) -> None:
        self.pieces[self.next] = piece
        bisect.insort(self.keys, (piece[2], -self.next))
        self.next += 1
        self.tokens += piece[2]

    def pop(self, at: int = -1) -> tuple[int, int, int]:
        length, n = self.keys.pop(at)
        self.tokens -= length
        return self.pieces.pop(-n)

    def best(self, room: int) -> int:
        """Where the longest piece of at most room tokens is, or -1."""
        return bisect.bisect_left(self.keys, (room + 1, -(1 << 62))) - 1


class Packer:
    """Pieces (document, start, length) into sequences whose tokens all belong to documents.

    A document gives whole windows of the largest tier first; its rest is routed to the smallest tier that holds it. From
    the longest tier down, a sequence begins with the tier's longest piece; its gap takes the longest fitting pieces of
    the shorter tiers, and at last a piece cut to size. So sequences are full; what a tier can't fill goes down a tier.
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.sizes = sorted(tiers)
        self.tiers = {n: Tier() for n in self.sizes}
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def route(self, piece: tuple[int, int, int]) -> None:
        doc, start, n = piece
        most = self.sizes[-1]
        while n >= most:
            self.done.append((most, [(doc, start, most)]))
            start, n = start + most, n - most
        if n:
            self.tiers[next(t for t in self.sizes if t >= n)].add((doc, start, n))

    def fill(self, size: int) -> None:
        """Sequences of this size from this tier and the shorter ones, while they have the tokens for it."""
        own = self.tiers[size]
        shorter = [self.tiers[t] for t in reversed(self.sizes) if t < size]
        have = own.tokens + sum(t.tokens for t in shorter)
        while own.keys and have >= size:
            taken = [own.pop()]
            room = size - taken[0][2]
            for tier in (*shorter, own):
                while room and (at := tier.best(room)) >= 0:
                    taken.append(tier.pop(at))
                    room -= taken[-1][2]
            if room:  # nothing left fits whole, so the shortest piece that is longer gives a part
                tier = next(t for t in (*reversed(shorter), own) if t.keys)
                doc, start, n = tier.pop(0)
                taken.append((doc, start, room))
                self.route((doc, start + room, n - room))
            self.done.append((size, taken))
            have -= size

    def round(self) -> None:
        for size in reversed(self.sizes):
            self.fill(size)

    def finish(self) -> None:
        """The rest, less than two windows of any tier, as sequences whose lengths are powers of two, longest first."""
        left = [t.pop() for n in reversed(self.sizes) for t in [self.tiers[n]] for _ in range(len(t.keys))]
        total = sum(n for _, _, n in left)
        while total:
            size = min(self.sizes[-1], 1 << (total.bit_length() - 1))
            taken, room = [], size
            while room:
                doc, start, n = left.pop(0)
                taken.append((doc, start, min(n, room)))
                if n > room:
                    left.insert(0, (doc, start + room, n - room))
                room -= min(n, room)
            self.done.append((size, taken))
            total -= size


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, tiers: tuple[int, ...] = (128, 256, 512, 1024), step_tokens: int = STEP_TOKENS, held_tokens: int = HELD_TOKENS, specials: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    tiers are powers of two. Each input partition packs its own documents, without a shuffle, holding about held_tokens
    tokens at a time; every sequence is full, its length being its tier (the last few of a partition: a power of two).
    sequence_id is the partition's number times 2**40 plus a count; step_group numbers groups of step_tokens tokens of one
    tier in the same way, so a step never mixes lengths and steps weigh the same. Null and empty texts have end_id alone.
    Strings of special tokens become their ids, as in the library's plain call; specials=False takes them as text.
    Repeated rows and null ids are documents of their own. Pieces of one row carry its row number (doc_row) in the partition.
    """
    path = path or vocabulary()
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    ddl = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint, doc_row bigint, ids array<int>"
    schema = arrow_schema(ddl)
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, specials), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        packer, held, n_held, row, sequence = Packer(tiers), {}, 0, 0, 0
        steps: dict[int, list[int]] = {}  # by tier: its step group, and the tokens there
        groups = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, groups
            for at in range(0, len(packer.done), 512):
                cols: list[list] = [[] for _ in range(10)]
                data = []
                for size, pieces in packer.done[at : at + 512]:
                    step = steps.setdefault(size, [-1, step_tokens])
                    if step[1] + size > step_tokens and step[1]:
                        step[:] = groups, 0
                        groups += 1
                    step[1] += size
                    offset = 0
                    for doc, start, n in pieces:
                        doc_id, ids, total = held[doc]
                        part = ids[start * 4 : (start + n) * 4]
                        data.append(part)
                        for c, v in zip(cols, (doc_id, start, n, zlib.crc32(part), total, base + sequence, offset, size, base + step[0], doc)):
                            c.append(v)
                        offset += n
                    sequence += 1
                ends = np.cumsum([0, *cols[2]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4"))).cast(schema.field("ids").type)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(cols)), lists], schema=schema)
            packer.done.clear()
            waiting = {p[0] for t in packer.tiers.values() for p in t.pieces.values()}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]

        for batch in gathered(batches, TOGETHER):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                held[row] = doc_id, ids, len(ids) // 4
                packer.route((row, 0, len(ids) // 4))
                n_held += len(ids) // 4
                row += 1
                if n_held >= held_tokens:
                    packer.round()
                    yield from out()
                    n_held = sum(t.tokens for t in packer.tiers.values())
        packer.round()
        packer.finish()
        yield from out()

    return map_arrow(rows, run, ddl)
