"""Toxicity by a factorization machine over hashed terms.

A term is a word, or the first letters of one, by its 64-bit hash. Besides a weight, each selected term has a factor
vector, and two terms that meet in a text add the product of theirs: an insult and the mention of a group can weigh
together what neither weighs alone, which additive weights can't express.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.llm.common import cut, drop_cut, map_arrow, picked
from rillspark.llm.quality import spans
from rillspark.llm.words import parts

#: First letters of longer words that are terms too, so that inflected and compound forms share one.
STEMS = (4, 5)
_EDGES = ".,;:!?\"'()[]{}<>|*_-«»“”„…¿¡"
#: Bounds of what is fitted: labelled texts and selected terms.
ROWS, TERMS = 20_000, 4096
#: Characters of texts whose terms are held at once, and words whose terms a task keeps.
PART, _KEPT = 1 << 20, 200_000


def terms(word: str) -> list[int]:
    word = word.strip(_EDGES)
    if not word:
        return []
    found = [word.encode(), *(b"^" + word[:n].encode() for n in STEMS if len(word) > n)]
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t in found]


def _coded(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different lower-case words of the texts; the number of each word in order; the text it stands in."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))


def _pairs(texts: list[str], look) -> tuple[np.ndarray, np.ndarray]:
    """The different (text, what look gives for one of its words), by text."""
    words, codes, doc = _coded(texts)
    found = [look(w) for w in words]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    values, flat = np.unique(np.array([x for f in found for x in f], np.int64), return_inverse=True)
    hit = lengths[codes] > 0
    key = np.unique(doc[hit] * max(1, len(found)) + codes[hit])  # each word of a text once
    doc, codes = np.divmod(key, max(1, len(found)))
    starts = spans(lengths[codes])
    which = flat[np.arange(starts[-1]) - np.repeat(starts[:-1] - spans(lengths)[codes], lengths[codes])]
    both = np.unique(np.repeat(doc, lengths[codes]) * max(1, len(values)) + which)
    doc, which = np.divmod(both, max(1, len(values)))
    return doc, values[which] if len(values) else which


@dataclass
class Machine:
    """Selected term hashes in order, their weights and factors, and the bias."""

    hashes: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def margin(self, rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[ids]
        total = np.stack([np.bincount(rows, v[:, f], minlength=n) for f in range(v.shape[1])], 1)
        squares = np.bincount(rows, (v * v).sum(1), minlength=n)
        return self.bias + np.bincount(rows, self.w[ids], minlength=n) + 0.5 * ((total**2).sum(1) - squares), total

    def scores(self, texts: list[str | None], known: dict[str, tuple]) -> np.ndarray:
        """known: what a worker has found of words so far."""
        index = {h: i for i, h in enumerate(self.hashes.tolist())} if not known else known["\0"]
        known.setdefault("\0", index)

        def look(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                found = tuple(index[h] for h in terms(word) if h in index)
                if len(known) < _KEPT and len(word) < 64:
                    known[word] = found
            return found

        made = []
        for a, z in parts([t or "" for t in texts], PART):  # a bound on what is held of a batch
            rows, ids = _pairs(texts[a:z], look)
            made.append(self.margin(rows, ids, z - a)[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(made) if made else np.zeros(0), -500, 500)))

    def fit(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float, seed: int) -> None:
        """AdaGrad on the logistic loss; rows are in order, so a batch is a slice of the pairs."""
        rng, n = np.random.default_rng(seed), len(y)
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        at = np.searchsorted(rows, np.arange(n + 1))
        for _ in range(epochs):
            order = rng.permutation(n)
            for some in np.array_split(order, max(1, n // 128)):
                pair = np.concatenate([np.arange(at[r], at[r + 1]) for r in some]) if len(some) else np.zeros(0, np.int64)
                own = np.repeat(np.arange(len(some)), at[some + 1] - at[some])
                term = ids[pair]
                score, total = self.margin(own, term, len(some))
                g = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - y[some]
                used, where = np.unique(term, return_inverse=True)
                dw = np.bincount(where, g[own], minlength=len(used)) / len(some) + decay * self.w[used]
                dv = g[own][:, None] * (total[own] - self.v[term])
                dv = np.stack([np.bincount(where, dv[:, f], minlength=len(used)) for f in range(dv.shape[1])], 1) / len(some) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += g.mean() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * g.mean() / np.sqrt(gb)


def _bias(n1: int, n: int) -> float:
    """The log odds of n1 toxic texts of n, next to ten that are as good as clean."""
    share = (n1 + 0.5) / (n + 10)
    return float(np.log(share / (1 - share)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, n_terms: int = TERMS, evidence: float | None = None, factors: int = 8, epochs: int = 20, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Fit a machine on at most `rows` labelled texts that are not held out, the first by a hash of the id.

    Only texts and labels are inputs. Rows with a null id, text or label are left out; of several labels of an id the
    greatest counts, and each different text of an id is an example. Terms are counted on the executors, and the n_terms of
    most evidence (a likelihood ratio statistic) are selected, of those that reach `evidence`; by default twice the logarithm
    of the number of terms, which about one term reaches by chance however many there are. The driver gets the selected
    terms of each example. Without examples every score is 0.05.
    """
    label = picked(labels, its_id=id_col, y=label_col).where(F.col("y").isNotNull() & F.col("its_id").isNotNull() & ~held_out(F.col("its_id")))
    sample = label.groupBy("its_id").agg((F.max("y") > 0).cast("int").alias("y")).orderBy(F.xxhash64("its_id"), "its_id").limit(rows)
    # at most `rows` ids and labels are broadcast, and then at most `rows` ids with the hash of a text
    joined = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("its_id")).where("text is not null").withColumn("h", F.xxhash64("text"))
    chosen = joined.select("its_id", "h").distinct().orderBy(F.xxhash64("its_id"), "its_id", "h").limit(rows)
    examples = joined.join(F.broadcast(chosen), ["its_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    examples = cut(examples.select("doc_id", "text", "y"), "examples")
    every, counted = T.StructType.fromDDL("term bigint, n1 bigint, n0 bigint"), pa.schema([("term", pa.int64()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at, end in parts(texts, PART):
                y = labels[at:end]
                doc, term = _pairs(texts[at:end], terms)
                found, which = np.unique(term, return_inverse=True)
                n1 = np.bincount(which, y[doc], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n1), pa.array(np.bincount(which, minlength=len(found)) - n1)], schema=counted)

    totals = examples.agg(F.sum("y"), F.count("*")).first()
    n1, n = totals[0] or 0, totals[1]
    if not n:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), _bias(0, 0))
    sums = cut(map_arrow(examples.select("text", "y"), count, every).groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    least = evidence if evidence is not None else 2 * math.log(max(2, sums.count()))

    def part(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)

    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d, one, zero = n1 - a, (n - n1) - b, F.lit(float(n1)), F.lit(float(n - n1))
    score = 2 * (part(a, a + b, one) + part(b, a + b, zero) + part(c, c + d, one) + part(d, c + d, zero))
    chosen = sums.select("term", score.alias("g")).where(F.col("g") >= least).orderBy(F.desc("g"), "term").limit(n_terms)
    hashes = np.sort(np.array([r.term for r in chosen.collect()], np.int64))
    rng, known = np.random.default_rng(seed), {h: (i,) for i, h in enumerate(hashes.tolist())}
    kept = T.StructType.fromDDL("doc_id string, y int, ids array<int>")
    sent = pa.schema([("doc_id", pa.string()), ("y", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, made = b.column(1).to_pylist(), []
            for at, end in parts(texts, PART):
                doc, term = _pairs(texts[at:end], lambda w: [i for t in terms(w) for i in known.get(t, ())])
                made += np.split(term, np.searchsorted(doc, np.arange(1, end - at)))
            yield pa.RecordBatch.from_arrays([pc.cast(b.column(0), pa.string()), b.column(2), pa.array([i.tolist() for i in made], sent[2].type)], schema=sent)

    # in order of id and then content, so that fits agree whatever the partitions
    data = sorted((r.doc_id, r.y, r.ids) for r in map_arrow(examples, select, kept).collect())
    for t in (examples, sums):
        drop_cut(t)
    y = np.array([r[1] for r in data], float)
    rows_of = np.repeat(np.arange(len(data)), [len(r[2]) for r in data])
    ids = np.array([i for r in data for i in r[2]], np.int64)
    machine = Machine(hashes, np.zeros(len(hashes)), rng.normal(0, 0.02, (len(hashes), factors)), _bias(n1, n))
    machine.fit(rows_of, ids, y, epochs, rate, decay, seed)
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a double column `name`, 0 to 1, by the whole text of each row; null texts score as empty ones.

    All other columns pass through; `name` must not be one of them.
    """
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    at = docs.columns.index(text_col)
    known: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = machine.scores(b.column(at).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, machine: Machine, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below `least`, with the columns of docs. Null texts score as empty ones; repeated rows and null ids stay or go as their texts do."""
    name = next(n for n in (f"__score{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return score(docs, machine, text_col, name).where(F.col(name) < least).drop(name)
