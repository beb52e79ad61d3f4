"""Quality rules by tokeniser fertility: how two public vocabularies cut a text's words, with bands per language or script.

A 32,000-piece vocabulary with byte fallback gives characters per token, the share of byte tokens and the token entropy; a
byte-level vocabulary for many languages gives characters per token once more, which tells a language's own words from runs
of symbols and menus. Bands were measured with measured_bands() and are written down below.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import arrow_schema, map_arrow, picked
from rillspark.llm.vocab import vocabulary

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
_SPACE = re.compile(r"\s")
WINDOW = 8
#: Bytes of texts worked on at once, and different words whose pieces a worker keeps.
PART_BYTES, KEPT = 1 << 20, 200_000

#: First code points of ranges of letters, in order, and the script of each; None: no letters of a script told apart here.
SCRIPTS = (
    (0x41, "Latin"), (0x5B, None), (0x61, "Latin"), (0x7B, None), (0xAA, "Latin"), (0xAB, None), (0xB5, "Latin"), (0xB6, None), (0xC0, "Latin"), (0xD7, None), (0xD8, "Latin"), (0xF7, None), (0xF8, "Latin"), (0x2B0, None),
    (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Other"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, None),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, None), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, "Other"), (0xFE00, None), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, None), (0x20000, "Han"), (0x32000, None),
)


@dataclass(frozen=True)
class Band:
    """What a text of a language or script must keep to: characters per token from and to, by either vocabulary; the most
    byte-fallback tokens a token; and the least token entropy as a share of that of as many different tokens (asked of
    `asked` tokens and more)."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float = 0.25
    asked: int = 64
    least_chars2: float = 0.0
    most_chars2: float = 50.0


#: A language of the lang column goes before its script. The languages' least values are about the 0.3rd percentiles of the
#: texts of sf0.1 that pass the base and are labelled good; of such texts 0.4 % fall out, of those labelled bad 88 %. Scripts have
#: wide bands, since no table here has texts of them.
BANDS = {
    "en": Band(1.85, 7, 0.12, 0.45, 64, 2.09, 7), "de": Band(2.05, 7, 0.12, 0.45, 64, 2.15, 7), "fr": Band(1.65, 7, 0.12, 0.45, 64, 1.9, 7), "es": Band(1.75, 7, 0.12, 0.45, 64, 1.93, 7),
    "Latin": Band(1.3, 7, 0.15), "Greek": Band(0.6, 4, 0.2), "Cyrillic": Band(0.9, 6, 0.2), "Hebrew": Band(0.5, 3, 0.3), "Arabic": Band(0.5, 3, 0.3),
    "Han": Band(0.3, 2, 0.95), "Kana": Band(0.4, 2, 0.7), "Hangul": Band(0.3, 2, 0.95), "Thai": Band(0.3, 2, 0.95), "Indic": Band(0.3, 2, 0.95), "Other": Band(0.2, 7, 0.95),
}


class Pieces:
    """The pieces of words by a sentencepiece vocabulary; each word is cut by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.known: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the words in order, and how many each word has."""
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.model.encode([words[i] for i in new], num_threads=1)):
            found[i] = np.array(ids, np.int32).tobytes()
            if len(self.known) < KEPT and len(words[i]) < 64:
                self.known[words[i]] = found[i]
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4


class Counts:
    """How many tokens a byte-level vocabulary makes of each word after a space; the ranks are lines of base64 and number."""

    #: Characters of a word that are encoded together, longer ones are cut; and words that one string holds.
    CUT, JOINED = 256, 400

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(b) for b in ranks]
        self.known: dict[str, int] = {}

    def alone(self, word: str) -> int:
        return sum(len(self.encoding.encode_ordinary(p)) for p in [" " + word[: self.CUT], *(word[a : a + self.CUT] for a in range(self.CUT, len(word), self.CUT))])

    def together(self, words: list[str]) -> list[int]:
        """Words are split apart before every space, so many are encoded as one string and counted by their bytes."""
        out: list[int] = []
        for i in range(0, len(words), self.JOINED):
            pieces = [" " + w for w in words[i : i + self.JOINED]]
            ends = np.cumsum(self.lengths[self.encoding.encode_ordinary("".join(pieces))])
            at = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in pieces])) + 1
            out += np.diff(at, prepend=0).tolist()
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        plain = [i for i in new if len(words[i]) <= self.CUT and not _SPACE.search(words[i])]
        for i, n in zip(plain, self.together([words[i] for i in plain])):
            found[i] = n
        for i in new:
            if found[i] is None:
                found[i] = self.alone(words[i])
            if len(self.known) < KEPT and len(words[i]) < 64:
                self.known[words[i]] = found[i]
        return np.array(found, np.int64)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(path)


def spans(counts: np.ndarray) -> np.ndarray:
    """Where each of these counts begins in their row, and the end."""
    return np.concatenate(([0], np.cumsum(counts)))


def repeat_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words within WINDOW-word windows that it has twice or more. codes: equal words, equal numbers."""
    if len(codes) < WINDOW:
        return np.zeros(n_docs, np.int64)
    run, size = codes.astype(np.int64), 1
    while size < WINDOW:  # numbers for windows of twice the size, from pairs of windows: exact, no hash
        run = np.unique(run[:-size] * (run.max() + 1) + run[size:], return_inverse=True)[1]
        size *= 2
    own = doc[: len(run)] == doc[WINDOW - 1 :]
    at = np.nonzero(own)[0]
    _, which, times = np.unique(doc[at].astype(np.int64) * (len(run) + 1) + run[at], return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n_docs)


def scripts(texts: list[str]) -> list[str]:
    """The script that most letters of each text have; ties go to the first in SCRIPTS, no letters to Other."""
    names = list(dict.fromkeys(s for _, s in SCRIPTS if s))
    of = np.array([-1, *(names.index(s) if s else -1 for _, s in SCRIPTS)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    found = of[np.searchsorted([p for p, _ in SCRIPTS], points, side="right")]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount((doc * len(names) + found)[found >= 0], minlength=len(texts) * len(names)).reshape(-1, len(names))
    return [names[int(c.argmax())] if c.any() else "Other" for c in counts]


def measure(texts: list[str], cut: Pieces, many: Counts) -> dict[str, list]:
    """The columns of rules() for these texts, without the verdicts."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    counts = np.diff(lists.offsets.to_numpy())
    coded = lists.values.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), counts)
    if "" in words:  # what stands before leading and after trailing white space
        real = codes != words.index("")
        codes, doc = codes[real], doc[real]
    ids, lengths = cut(words)
    at = spans(lengths)
    n_words = np.bincount(doc, minlength=n)
    per_word = lengths[codes]
    token_doc = np.repeat(doc, per_word)
    starts = spans(per_word)
    tokens = ids[np.arange(starts[-1]) - np.repeat(starts[:-1] - at[codes], per_word)]
    n_tokens = np.bincount(token_doc, minlength=n)
    n_bytes = np.bincount(token_doc[cut.is_byte[tokens]], minlength=n)
    pair, times = np.unique(token_doc * cut.size + tokens, return_counts=True)
    some = np.maximum(n_tokens, 1)
    entropy = np.log2(some) - np.bincount(pair // cut.size, times * np.log2(times), minlength=n) / some
    chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
    tokens2 = np.bincount(doc, many(words)[codes], minlength=n)
    dup = []
    for t in texts:
        real_lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup.append(len(real_lines) - len(set(real_lines)))
    return {
        "n_words": n_words.tolist(), "word_chars": chars.tolist(), "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": dup,
        "n_repeat_words": repeat_words(codes, doc, n).tolist(), "n_tokens": n_tokens.tolist(), "chars_per_token": (chars / some).tolist(),
        "chars_per_token2": (chars / np.maximum(tokens2, 1)).tolist(), "byte_share": (n_bytes / some).tolist(), "token_entropy": np.abs(entropy).tolist(), "script": scripts(texts),
    }


def verdict(band: Band, n_tokens: int, chars: float, chars2: float, byte_share: float, entropy: float) -> str | None:
    """The first rule that a text breaks, or None."""
    if not n_tokens:
        return "tokens"
    if not band.least_chars <= chars <= band.most_chars:
        return "chars_per_token"
    if not band.least_chars2 <= chars2 <= band.most_chars2:
        return "chars_per_token2"
    if byte_share > band.most_bytes:
        return "byte_share"
    if n_tokens >= band.asked and entropy < band.least_entropy * np.log2(n_tokens):
        return "token_entropy"
    return None


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] | None = None, path: str | None = None, path2: str | None = None) -> DataFrame:
    """Measures and verdicts of every whole text, a row for each input row, without a shuffle.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are the base; base_failed: under 20 words, or over 30 %
    of the words repeat in windows. chars_per_token, byte_share and token_entropy (bits) come from each word's pieces,
    chars_per_token2 from its tokens in the second vocabulary. band names what the text was held to: its language if it
    has a band, else the script of most letters; rejected_by the first measure that is out of the band (null: none); kept:
    not base_failed and within the band. Null and empty texts have zeros and are not kept; repeated rows and null ids stay.
    """
    bands, path, path2 = bands or BANDS, path or vocabulary("piece_bpe_32k.model"), path2 or vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = picked(docs, doc_id=id_col, text=text_col, **({"lang": lang_col} if lang_col else {}))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_tokens bigint, chars_per_token double, chars_per_token2 double, byte_share double, token_entropy double, band string, rejected_by string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, many = pieces(path), counts_of(path2)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            langs = b.column(2).to_pylist() if lang_col else [None] * len(texts)
            groups, size = [0], 0
            for i, t in enumerate(texts):
                if size and size + len(t) > PART_BYTES:
                    groups.append(i)
                    size = 0
                size += len(t)
            for a, z in zip(groups, [*groups[1:], len(texts)]):
                if a == z:
                    continue
                m = measure(texts[a:z], cut, many)
                failed = [n < 20 or 100 * r > 30 * n for n, r in zip(m["n_words"], m["n_repeat_words"])]
                band = [lang if lang in bands else script for lang, script in zip(langs[a:z], m["script"])]
                broken = [verdict(bands[k], *x) for k, x in zip(band, zip(m["n_tokens"], m["chars_per_token"], m["chars_per_token2"], m["byte_share"], m["token_entropy"]))]
                m |= {"base_failed": failed, "kept": [not f and k is None for f, k in zip(failed, broken)], "band": band, "rejected_by": broken}
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *(pa.array(m[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    return map_arrow(rows, run, ddl)


def measured_bands(measured: DataFrame, share: float = 0.003) -> DataFrame:
    """What bands may be set by: for each band of rules()'s rows that pass the base, their number and the percentiles `share` and 1 - share of each measure."""
    spread = F.col("token_entropy") / F.log2(F.greatest("n_tokens", F.lit(2)))
    of = {"chars_per_token": F.col("chars_per_token"), "chars_per_token2": F.col("chars_per_token2"), "byte_share": F.col("byte_share"), "entropy_share": spread}
    at = F.array(F.lit(share), F.lit(1 - share))
    return measured.where(~F.col("base_failed")).groupBy("band").agg(F.count("*").alias("n"), *(F.percentile_approx(c, at, 10_000).alias(k) for k, c in of.items()))
