"""Near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is a row of positional bytes. Texts that are near share many bytes at their own positions, so the index has
postings by several such bytes at once, the pairs that meet in a posting tally the bytes they share at all positions, those
that reach the minimum are candidates, and candidates are verified.

near_duplicates() works on SimHash fingerprints of 8 bytes, and its minimum is guaranteed: fingerprints that differ in at
most d bits share at least 8 - d bytes. one_of_each() asks for a similarity of word shingles, at which SimHash guarantees no
shared byte; its positional bytes are samples of the shingles instead (see samples()).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import arrow_schema, cut, drop_cut, map_arrow, picked
from rillspark.llm.graph import components
from rillspark.llm.words import parts, shingles

#: Fewest fingerprints of a posting that are compared by flipped bits instead of one another.
WIDE = 256
#: Most rows of a posting that are compared by the distance between their places; both ways give the same pairs.
FEW = 16
#: Most tallies held at once between the rows of a large posting.
CELLS = 1 << 18
#: Rows of a posting that are led at once; of more, only those that lead are kept for the rest.
HELD = 1 << 16


# SimHash of whole texts


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text in order, repeats included; words lose A-Z; fewer words are one shingle, none gives none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half the hashes; no hashes, all bits 0."""
    counts = np.zeros(64, np.int64)
    part = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(part), 1 << 16):
        counts += np.unpackbits(part[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer for each row.

    Null and empty texts get fingerprint zero. Repeated rows and null ids keep a row each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([simhash(shingle_hashes(x, shingle, seed)) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["doc_id", "fp"])

    rows = picked(docs, doc_id=id_col, text=text_col)
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _flips(bits: list[int], most: int) -> np.ndarray:
    """All 64-bit masks with 1 to most of these bits set."""
    return np.array([sum(1 << b for b in chosen) for n in range(1, most + 1) for chosen in itertools.combinations(bits, n)], np.uint64)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints share the guaranteed count of positional bytes, and then differ in at most `most` bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).view(np.uint64)[..., 0]  # a 1 in each byte that is shared
    return (np.bitwise_count(shared) >= 8 - most) & (np.bitwise_count(x) <= most)


def _roots(fps: np.ndarray, most: int, free: np.ndarray) -> np.ndarray:
    """The index of a representative for each of these sorted distinct fingerprints, by links of at most `most` bits among them.

    In a large posting the near ones of a fingerprint are looked up: all that differ in at most `most` of the free bits.
    """
    n = len(fps)
    root = np.arange(n)
    if n <= WIDE:
        near = _near(fps[:, None], fps[None, :], most)
        while True:
            new = np.where(near, root[None, :], n).min(1)
            new = new[new]
            if (new == root).all():
                return root
            root = new
    found = []
    for mask in _flips(free.tolist(), most):
        other = fps ^ mask
        at = np.minimum(np.searchsorted(fps, other), n - 1)
        hit = np.nonzero(fps[at] == other)[0]
        found.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*found))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _links(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b): for each posting, a spanning forest of the links of at most `most` bits among its fingerprints: fewer links than members.

    The eight positions are four pairs. `most` bits (0 to 3) lie in at most so many pairs, so near fingerprints have 4 - most
    pairs whole, and meet in the posting of those: for two bits, six postings of four positional bytes each. A posting by
    four bytes holds N / 2**32 of N unrelated fingerprints.
    """
    pairs = [0xFFFF << (16 * p) for p in range(4)]
    masks = [sum(chosen) for chosen in itertools.combinations(pairs, 4 - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))
    rows = distinct.select("fp", F.explode(keys).alias("x")).select("x.c", "x.k", "fp")
    schema = arrow_schema("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the posting that the last batch may not have ended
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if left is None:
                    return
                c, k, fp = left
                done = len(fp)
            else:
                c, k, fp = (batch.column(i).to_numpy() for i in range(3))
                if left is not None:
                    c, k, fp = (np.concatenate(x) for x in zip(left, (c, k, fp)))
                if not len(fp):
                    continue
                same = (c == c[-1]) & (k == k[-1])
                done = len(fp) - int(np.argmin(same[::-1])) if not same.all() else 0
                left = (c[done:], k[done:], fp[done:])
                c, k, fp = c[:done], k[:done], fp[:done]
            if not done:
                continue
            starts = np.concatenate(([0], np.nonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1]))[0] + 1, [done]))
            sizes = np.diff(starts)
            u = fp.view(np.uint64)
            two = starts[:-1][sizes == 2]
            two = two[_near(u[two], u[two + 1], most)]
            out = [(fp[two], fp[two + 1])]
            for i in np.nonzero(sizes > 2)[0]:
                own = np.sort(u[starts[i] : starts[i + 1]])
                mask = masks[int(c[starts[i]])]
                root = _roots(own, most, np.array([b for b in range(64) if not mask >> b & 1]))
                moved = np.nonzero(root != np.arange(len(own)))[0]
                out.append((own[root[moved]].view(np.int64), own[moved].view(np.int64)))
            a, b = (np.concatenate(x) for x in zip(*out))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
            if batch is None:
                return

    return map_arrow(rows.repartition("c", "k").sortWithinPartitions("c", "k"), run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, most_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: components of the links of at most most_bits bits (0 to 3).

    component_id is the least id reachable, null only if every id there is null. Equal fingerprints are one node, so
    groups of copies cost one node however large they are; a component's least id comes from its nodes' least ids, and
    rows meet their node's row in a join that Spark can split. Null and empty texts share fingerprint zero and are linked
    like any other. Repeated rows stay; an empty table gives an empty result.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("most_bits must be 0 to 3")
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = cut(_links(nodes.select("fp"), most_bits), "links")
    roots = components(links)
    drop_cut(links)
    linked = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = cut(linked.join(least, "root").select("fp", "component_id").union(nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))), "components")
    for t in (nodes, linked, least):
        drop_cut(t)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# similar texts


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: equal texts, equal keys. Null texts are empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def samples(texts: list[str], n_bytes: int, shingle: int) -> np.ndarray:
    """The positional bytes of each text (rows of n_bytes): the byte at a position is of the shingle that comes first in that position's order.

    It is the SimHash byte of a sample of one shingle. Two texts share a byte with the chance of their shingles' Jaccard
    similarity, and 1/256 of the rest; each shingle counts once, however often it is repeated. No words: zeros.
    """
    out = np.zeros((len(texts), n_bytes), np.uint8)
    rng = np.random.default_rng(42)
    flip, times = rng.integers(0, 1 << 64, (n_bytes, 2), np.uint64, endpoint=False).T  # a position's order hangs on its number alone
    for a, z in parts(texts):
        h, doc = shingles(texts[a:z], shingle)
        if not len(h):
            continue
        at = np.concatenate(([0], np.nonzero(np.diff(doc))[0] + 1))
        for k in range(n_bytes):
            first = np.minimum.reduceat((h ^ flip[k]) * (times[k] | np.uint64(1)), at)
            out[a + doc[at], k] = (first >> np.uint64(8)).astype(np.uint8)
    return out


def position_choices(n_bytes: int, size: int, n: int, seed: int = 5) -> list[tuple[int, ...]]:
    """n different choices of `size` positional bytes that use every position about as often."""
    rng, found = np.random.default_rng(seed), {}
    while len(found) < n:
        order = rng.permutation(n_bytes)
        for i in range(0, n_bytes - size + 1, size):
            found[tuple(sorted(order[i : i + size].tolist()))] = True
    return list(found)[:n]


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values that all have `width` bytes, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _tally(prints: np.ndarray, i, j) -> np.ndarray:
    """How many positional bytes rows i and j of these prints share."""
    same = prints[i] == prints[j]
    return np.bitwise_count(same.view(np.uint64)).sum(-1, dtype=np.int16)


def _led(prints: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a large posting: the first lead that each is near, or itself; whether a row that leads none is near one that is led."""
    n = len(prints)
    lead, todo = np.arange(n), np.arange(n)
    while len(todo):
        close = _tally(prints, todo[:1], todo) >= least
        lead[todo[close]] = todo[0]
        todo = todo[~close]
    led = np.nonzero(lead != np.arange(n))[0]
    alone = np.setdiff1d(np.nonzero(lead == np.arange(n))[0], lead[led])
    near = np.zeros(n, bool)
    step = max(1, CELLS // max(1, len(led)))
    for at in range(0, len(alone) if len(led) else 0, step):
        part = alone[at : at + step]
        near[part] = (_tally(prints, part[:, None], led[None, :]) >= least).any(1)
    return lead, near


def _across(prints: np.ndarray, root: np.ndarray, n_bytes: int, least: int, fine: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of near rows of different roots, for rows in order of root: all, or those that are among the `most` best of either row.

    Near rows tally `least` of their first n_bytes bytes, and then `fine` of all.
    """
    n, i = len(root), 0
    ends = np.searchsorted(root, root, side="right")
    coarse = np.ascontiguousarray(prints[:, :n_bytes])
    step = max(1, CELLS // n)
    found: list[tuple[np.ndarray, ...]] = []
    while i < n:
        j = min(n, i + step)
        start = int(ends[i])  # rows of roots after that of row i
        a, b = np.nonzero((_tally(coarse, np.arange(i, j)[:, None], np.arange(start, n)[None, :]) >= least) & (root[i:j, None] < root[None, start:]))
        a, b = a + i, b + start
        shared = np.concatenate([_tally(prints, a[k : k + (1 << 12)], b[k : k + (1 << 12)]) for k in range(0, len(a), 1 << 12)]) if len(a) else np.zeros(0, np.int16)
        good = shared >= fine
        if most is None:
            yield a[good], b[good]
        else:
            found.append((a[good], b[good], shared[good]))
            if sum(len(f[0]) for f in found) > CELLS or j == n:  # what is among the best of all is among the best of what is held
                a, b, shared = (np.concatenate(v) for v in zip(*found))
                keep = np.zeros(len(a), bool)
                for side in (a, b):
                    by = np.lexsort((b, a, -shared, side))
                    rank = np.arange(len(by)) - np.searchsorted(side[by], side[by])
                    keep[by[rank < most]] = True
                found = [(a[keep], b[keep], shared[keep])]
        i = j
    if found:
        yield found[0][:2]


def _candidates(prints: DataFrame, choices: list[tuple[int, ...]], n_bytes: int, least: int, most: int | None = None, fine_bytes: int = 0, fine: int = 0) -> DataFrame:
    """(a, b, shared): nodes that share all bytes of a choice and tally at least `least` shared bytes; prints (node, print) or (node, print, root).

    Without roots each row of a posting (b) joins one that is near (a), the first of the posting or one that leads there: one
    pair a row at most, however many copies. A row that is near others but in none of these pairs comes as a pair with
    itself, so that the nodes of the result are all that are near any. With roots, prints have fine_bytes bytes, of which
    pairs must share `fine` too, and the result has near pairs of different roots: those that are among the `most` best of a
    row of a posting, or all, each from the first choice whose bytes it shares only.
    """
    rooted = "root" in prints.columns
    width = fine_bytes if rooted else n_bytes
    ddl = "route bigint, node binary, print binary" + (", root binary" if rooted else "")
    schema, pair_ddl = arrow_schema(ddl), "a binary, b binary, shared int"
    pair, chosen = arrow_schema(pair_ddl), np.array(choices)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            single = _fixed(b.column(1), width)[:, :n_bytes].astype(np.int64)
            for part in np.array_split(np.arange(len(choices)), max(1, len(choices) * b.num_rows * width >> 21)):
                routes = []
                for c in part:
                    k = np.full(b.num_rows, c, np.int64)
                    for p in choices[c]:
                        k = k << 8 | single[:, p]
                    routes.append(k)
                cols = [pa.concat_arrays([b.column(i)] * len(part)) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(routes)), *cols], schema=schema)

    def first_shared(prints: np.ndarray, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of these pairs share the bytes of no choice before c."""
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 13):
            some = slice(at, at + (1 << 13))
            good[some] = (prints[i[some]] == prints[j[some]])[:, chosen].all(2).argmax(1) == c[some]
        return good

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the posting that goes on from batch to batch
        shift = 8 * len(choices[0])

        def met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            route = batch.column(0).to_numpy()
            start = np.concatenate(([True], route[1:] != route[:-1]))
            shared_key = np.nonzero(~start | np.concatenate((~start[1:], [False])))[0]
            if not len(shared_key):
                return
            batch = batch.take(pa.array(shared_key))  # rows that are alone in their posting are done
            route, prints = route[shared_key], _fixed(batch.column(2), width)
            root = np.unique(_fixed(batch.column(3), 16).view("S16")[:, 0], return_inverse=True)[1] if rooted else None
            starts = np.concatenate(([0], np.nonzero(route[1:] != route[:-1])[0] + 1))
            sizes = np.diff(np.append(starts, len(route)))
            few = np.repeat(sizes <= FEW, sizes)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            near, led = np.zeros(len(route), bool), np.zeros(len(route), bool)
            if rooted:
                for g in np.nonzero(sizes > 1)[0]:
                    a, z = starts[g], starts[g] + sizes[g]
                    own = root[a:z]
                    if (own != own[0]).any():
                        found += [(x + a, y + a) for x, y in _across(prints[a:z], own, n_bytes, least, fine, most) if len(x)]
            else:
                # postings of few nodes, a distance between rows at a time, the furthest first
                for step in range(min(FEW, int(sizes.max())) - 1, 0, -1):
                    at = np.nonzero(few[step:] & (route[step:] == route[:-step]))[0]
                    at = at[_tally(prints, at, at + step) >= least]
                    near[at] = near[at + step] = True
                    at = at[~led[at + step]]
                    led[at + step] = True
                    found.append((at, at + step))
                for g in np.nonzero(sizes > FEW)[0]:
                    a, z = starts[g], starts[g] + sizes[g]
                    lead, loose = _led(prints[a:z], least)
                    y = np.nonzero(lead != np.arange(z - a))[0]
                    near[a:z] |= loose
                    found.append((lead[y] + a, y + a))
            x, y = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if rooted and most is None:
                good = first_shared(prints, x, y, route[x] >> shift)
                x, y = x[good], y[good]
            elif not rooted:
                near[x] = near[y] = False
                loops = np.nonzero(near)[0]
                x, y = np.concatenate((x, loops)), np.concatenate((y, loops))
            for at in range(0, len(x), 1 << 15):
                i, j = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                cols = [batch.column(1).take(pa.array(v)) for v in (i, j)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_tally(prints, i, j).astype(np.int32))], schema=pair)

        def whole(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(some).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            route = b.column(0).to_numpy()
            new = np.nonzero(route != route[-1])[0]
            done = int(new[-1]) + 1 if len(new) else 0
            if done or held and held[0].column(0)[0].as_py() != route[0]:
                yield from met(whole([*held, b.slice(0, done)]))
                held = []
            held.append(b.slice(done))
            if not rooted and sum(h.num_rows for h in held) >= HELD:
                some = whole(held)
                own = _fixed(some.column(2), width)
                lead, _ = _led(own, least)
                leads, y = np.unique(lead), np.nonzero(lead != np.arange(len(lead)))[0]
                # those that lead come as pairs with themselves: what is near them may have gone by, or be near one that has
                cols = [some.column(1).take(pa.array(np.concatenate((v, leads)))) for v in (lead[y], y)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_tally(own, np.concatenate((lead[y], leads)), np.concatenate((y, leads))).astype(np.int32))], schema=pair)
                held = [some.take(pa.array(leads))]
        if held:
            yield from met(whole(held))

    rows = map_arrow(prints.select("node", "print", *(["root"] if rooted else [])), index, ddl)
    order = ("route", "root", "node") if rooted else ("route", "node")
    return map_arrow(rows.repartition("route").sortWithinPartitions(*order), meet, pair_ddl)


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, n_bytes: int = 64, key_bytes: int = 5, n_keys: int = 20, least: int = 38, fine_bytes: int = 512, fine: int = 371) -> DataFrame:
    """(a, b): pairs of different texts of which at least `similarity` of the word shingles are shared (Jaccard); texts (node, text).

    Words lose A-Z; fewer than `shingle` words are one shingle. Null texts count as empty; two texts without a word are similar.
    Repeated rows of a node count once; an empty table gives no pairs.
    The pairs connect all texts that the pairs found connect; pairs within a group are left out. node is text_key(). Texts
    as similar as `similarity` share each of n_bytes positional bytes with that chance, so they tally `least` of 64 or more but
    for 5 in 100,000, and meet in one of n_keys postings of key_bytes bytes but for 2 in 1,000 (README). A posting by
    five bytes holds N / 2**40 of N unrelated texts. Candidates are verified by their whole shingle sets, in rounds:
    first each text with the leading text that it shares most bytes with; then, of different groups left, each with its
    best in each posting; then all candidates between different groups that are left. From the second round on the
    texts that are near any have fine_bytes positional bytes, of which candidates share `fine` (but for 2 in 100,000).
    """
    schema, ddl = arrow_schema("node binary, print binary"), "a binary, b binary"
    pair = arrow_schema(ddl)

    def printed(some: DataFrame, width: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = samples([t or "" for t in b.column(1).to_pylist()], width, shingle)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in made], pa.binary())], schema=schema)

        return map_arrow(some.select("node", "text"), run, "node binary, print binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [c.to_pylist() for c in b.columns[2:4]]
            different = list(dict.fromkeys(itertools.chain(*sides)))
            h, doc = [], []
            for a, z in parts(different):
                own, at = shingles(different[a:z], shingle)
                h.append(own)
                doc.append(at + a)
            h, doc = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (h, doc))
            ends = np.searchsorted(doc, np.arange(len(different) + 1))
            sets = {t: np.unique(h[x:y]) for t, x, y in zip(different, ends.tolist(), ends[1:].tolist())}
            good = []
            for x, y in zip(*sides):
                p, q = sets[x], sets[y]
                both = np.sort(np.concatenate((p, q)))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(shared >= similarity * (len(p) + len(q) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2)], schema=pair)

    prints = cut(printed(texts, n_bytes).groupBy("node").agg(F.first("print").alias("print")), "prints")
    choices = position_choices(n_bytes, key_bytes, n_keys)
    led = cut(_candidates(prints, choices, n_bytes, least).distinct(), "candidates")
    near = led.select(F.col("a").alias("node")).union(led.select("b")).distinct()
    once = texts.groupBy("node").agg(F.first("text").alias("text"))  # copies meet in a partial aggregate before they are dealt
    near = cut(once.join(near, "node"), "near-texts")

    def verified(some: DataFrame) -> DataFrame:
        met = some.join(near.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(near.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return map_arrow(met.select("a", "b", "ta", "tb"), verify, ddl)

    tested = cut(led.where("a <> b").groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b"), "tested")
    found = cut(verified(tested), "similar")
    own = cut(printed(near, fine_bytes), "near-prints")
    drop_cut(prints)
    drop_cut(led)
    for most in (1, None):
        groups = components(found)
        left = own.join(groups, "node", "left").select("node", "print", F.coalesce("root", "node").alias("root"))
        more = _candidates(left, choices, n_bytes, least, most, fine_bytes, fine).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        before = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = cut(more.join(before, ["a", "b"], "left_anti"), "tested")
        held = (tested, found)
        tested, found = cut(tested.union(more), "tested"), cut(found.union(verified(more)), "similar")
        for t in (more, *held):
            drop_cut(t)
    for t in (near, own, tested):
        drop_cut(t)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, **more) -> DataFrame:
    """The rows of docs less near-duplicates: of each component of similar_texts(), the row of least id stays, once.

    Texts without a word, nulls among them, are one group. Null ids come last; of texts that share the least id, the least
    key stays. All columns pass.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.withColumns({"__node": text_key(text), "__last": doc_id.isNull(), "__id": doc_id})
    said = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")  # all that say nothing are one text
    found = similar_texts(docs.select(text_key(said).alias("node"), said.alias("text")), shingle, similarity, **more)
    roots = components(found)
    drop_cut(found)
    rows = rows.withColumn("__node", text_key(said))
    ids = rows.groupBy("__node", "__last", "__id").agg(F.count("*").alias("__n"))
    least = cut(ids.groupBy("__node").agg(F.min(F.struct("__last", "__id", "__n")).alias("its")), "least")
    best = least.join(roots, F.col("__node") == F.col("node"), "left").groupBy(F.coalesce("root", "__node").alias("root"))
    best = best.agg(F.min(F.struct("its.__last", "its.__id", "__node", "its.__n")).alias("best")).select("best.*")
    best = cut(best.select(F.col("__node").alias("__its_node"), F.col("__id").alias("__its_id"), "__n"), "kept")
    drop_cut(least)
    kept = rows.join(best, (F.col("__node") == F.col("__its_node")) & F.col("__id").eqNullSafe(F.col("__its_id")))
    once = kept.where("__n = 1").union(kept.where("__n > 1").dropDuplicates(["__node", "__id"]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
