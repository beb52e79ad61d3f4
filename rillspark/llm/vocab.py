"""Byte-level BPE of whole texts by the tokenizers library, with the ids of each word kept for its next occurrence.

The split that precedes this BPE puts a boundary before every space that a non-space follows, and around a single line
feed between non-spaces. So a text's ids are the ids of its words (with their space) in order, and the library encodes
each different word of a batch once at most, all of them in few calls. Whitespace runs follow the same split: all but the
last character are one piece, the last goes with the next word if it is a space and else stands alone; a run that ends
the text is one piece. Strings of added tokens, such as <|endoftext|>, are cut out first and become their own ids, as in the
library's plain call, unless an Encoder is told to take them as ordinary text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space but for the space and the line feed, as the split sees it.
_OTHER = "\t\x0b\x0c\r\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_RUNS = re.compile(f"([ \n{_OTHER}]+)")
#: Bytes of texts that are worth encoding together: the more, the fewer words are new.
TOGETHER = 8 << 20
#: Words whose ids are gathered at once.
GATHERED = 1 << 16
#: What stands before the first word of a text while it is cut; texts that hold it are cut otherwise.
MARK = "\x01"
#: Words kept for each of the two positions, after a space and elsewhere.
KEPT = 300_000
#: Words that one string given to the library holds.
JOINED = 400


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between non-spaces."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return False
    if text.isascii():
        return not ("\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text)
    return not any(c in text for c in _OTHER)


class _Words(dict):
    """Ids by word, for words that follow `before`."""

    def __init__(self, owner: Encoder, before: str):
        self.owner, self.before = owner, before
        self.slots: list[int] = []  # where the batch lacks a word, and the word
        self.words: list[str] = []

    def look(self, words: list[str], out: list) -> None:
        found = list(map(self.get, words))
        if None in found:
            at = len(out)
            for i, x in enumerate(found):
                if x is None:
                    self.slots.append(at + i)
                    self.words.append(words[i])
        out += found

    def settle(self, out: list) -> None:
        """Encode what the batch lacked and put it in its places."""
        if not self.slots:
            return
        new = list(dict.fromkeys(self.words))
        made = dict(zip(new, self.owner.encode_words(new, self.before)))
        for at, word in zip(self.slots, self.words):
            out[at] = made[word]
        for word, ids in made.items():
            if len(self) >= KEPT:
                break
            if len(word) < 64:
                self[word] = ids
        self.slots, self.words = [], []


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if specials or not t.special}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("an added token that takes white space or word edges is not supported")
        self.added = {s: np.array([i], "<u4").tobytes() for s, (i, _) in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        size = self.tokenizer.get_vocab_size()
        self.lengths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])  # a letter for each byte
        self.feed = self.piece("\n")
        self.body, self.head = _Words(self, " "), _Words(self, "\n")
        self.pieces: dict[str, bytes] = {}  # of plain texts; see _bulk()

    def piece(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str], before: str) -> list[bytes]:
        """The ids of each word after `before`; a line feed's own id is left out."""
        pieces = [before + w for w in words]
        texts = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1
        starts = np.concatenate(([0], ends[:-1])) + (before == "\n")
        data = ids.tobytes()
        return [data[a:z] for a, z in zip((starts * 4).tolist(), (ends * 4).tolist())]

    def _runs(self, text: str, out: list) -> None:
        parts = _RUNS.split(text)
        if parts[0]:
            self.head.look(parts[:1], out)
        for i in range(1, len(parts), 2):
            run, word = parts[i], parts[i + 1]
            if not word:
                out.append(self.piece(run))
                continue
            if len(run) > 1:
                out.append(self.piece(run[:-1]))
            if run[-1] != " ":
                out.append(self.piece(run[-1]))
            (self.body if run[-1] == " " else self.head).look([word], out)

    def _text(self, text: str, out: list) -> None:
        if not _plain(text):
            self._runs(text, out)
            return
        first = True
        for line in text.split("\n"):
            if not first:
                out.append(self.feed)
            first = False
            words = line.split(" ")
            self.head.look(words[:1], out)
            if len(words) > 1:
                self.body.look(words[1:], out)

    def _odd(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that hold added tokens, or white space other than single spaces and line feeds between words."""
        out, ends = [], [0]
        for text in texts:
            for part in self.at_added.split(text) if any(s in text for s in self.added) else [text]:
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    self._text(part, out)
            ends.append(len(out))
        self.head.settle(out)
        self.body.settle(out)
        return [b"".join(out[a:z]) for a, z in zip(ends, ends[1:])]

    def _bulk(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts. They are cut at spaces; a word that begins a line keeps its line feed, one that begins a text is marked.

        So each different piece of a batch has ids of its own, which are looked up once and gathered by its number.
        """
        marked = pc.replace_substring(pa.array([MARK + t for t in texts], pa.large_string()), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        coded = lists.values.dictionary_encode()
        different, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = list(map(self.pieces.get, different))
        new = [i for i, x in enumerate(found) if x is None]
        for before, prefix in ((" ", b""), ("\n", self.feed), (MARK, b"")):
            own = [i for i in new if different[i][0] == before] if before != " " else [i for i in new if different[i][0] not in "\n" + MARK]
            words = [different[i][before != " " :] for i in own]
            for i, ids in zip(own, self.encode_words(words, " " if before == " " else "\n") if own else ()):
                found[i] = prefix + ids
                if len(self.pieces) < KEPT and len(different[i]) < 64:
                    self.pieces[different[i]] = found[i]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths
        at, out = lists.offsets.to_numpy(), []
        del marked, lists, coded, different, found
        a = 0
        while a < len(texts):  # gathered a part at a time, which bounds what is held
            z = max(a + 1, int(np.searchsorted(at, at[a] + GATHERED, side="right")) - 1)
            own = codes[at[a] : at[z]]
            sizes = lengths[own]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            data = flat[np.arange(ends[-1]) + np.repeat(starts[own] - ends[:-1], sizes)].tobytes()
            cuts = (ends[at[a : z + 1] - at[a]] * 4).tolist()
            out += [data[i:j] for i, j in zip(cuts, cuts[1:])]
            a = z
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if _plain(t) and MARK not in t and not any(s in t for s in self.added) else odd).append(i)
        for some, encode in ((plain, self._bulk), (odd, self._odd)):
            for i, ids in zip(some, encode([texts[i] for i in some]) if some else ()):
                out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One for each Python worker; workers serve many tasks."""
    return Encoder(path, specials)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
