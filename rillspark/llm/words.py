"""Words of whole texts as numbers: 64-bit hashes of words and of runs of words, many texts at a time."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of texts that are hashed at once; a longer text goes alone.
PART_CHARS = 1 << 18
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash derived from h; the 0th is h."""
    if k == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def parts(texts: list[str], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of texts of about `most` characters."""
    a = size = 0
    for z, t in enumerate(texts, 1):
        size += len(t)
        if size >= most or z == len(texts):
            yield a, z
            a, size = z, 0


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _P))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64))))), dtype=np.uint64)
    return up, down


@dataclass
class Words:
    """The words of some texts in order: the hash of each with A-Z lowered, the number of its text, and where it begins and ends there."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(texts: list[str]) -> Words:
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    low = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    powers, inverse = _powers(1 << max(16, (len(points) + 1).bit_length()))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(low * powers[: len(points)], dtype=np.uint64)))
    # the length is hashed too, so that a leading NUL counts
    hashed = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _Q, 1)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(text_at, starts, side="right") - 1
    return Words(hashed, doc, starts - text_at[doc], ends - text_at[doc])


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of `size` neighbouring words from each position on that has as many, whatever texts they are of."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _Q + hashes[j : j + n]
    return mixed(out, 2)


@functools.lru_cache(maxsize=1)
def _run_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(q)))), dtype=np.uint64) for q in (int(_Q), pow(int(_Q), -1, 1 << 64)))


def run_sums(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A hash of `size` neighbouring words from each of these positions on, in a time that doesn't hang on size."""
    up, down = _run_powers(1 << max(16, len(hashes).bit_length()))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return mixed((sums[at + size] - sums[at]) * down[at], 2)


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of `size` words within a text, in order; of fewer words the whole text is one; none gives none."""
    w = words_of(texts)
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(w.doc, minlength=len(texts))
    hashed = runs(w.hash, size)
    own = np.nonzero(w.doc[: len(hashed)] == w.doc[size - 1 :])[0] if len(hashed) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    few = np.nonzero((count > 0) & (count < size))[0]
    short = np.array([runs(w.hash[at[d] : at[d + 1]], int(count[d]))[0] for d in few.tolist()], np.uint64)
    hashes, doc = np.concatenate((hashed[own], short)), np.concatenate((w.doc[own], few))
    order = np.argsort(doc, kind="stable") if len(few) else slice(None)
    return hashes[order], doc[order]
