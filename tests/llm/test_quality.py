"""Quality measures against plain Python on whole tables and awkward rows."""

import base64
import math
import random
import re
import unicodedata
from collections import Counter

import public_tokenizers
import tiktoken
from tests.llm.helpers import SF, awkward, empty

from rillspark.llm import contracts, quality
from rillspark.llm.vocab import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def many():
    """A tiktoken encoding of its own."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def letters_script(text):
    """Latin, Han, Cyrillic or other by Unicode names; enough for the texts of these tests."""
    found = Counter()
    for c in text:
        name = unicodedata.name(c, "")
        if c.isalpha():
            found["Han" if name.startswith("CJK") else "Cyrillic" if name.startswith("CYRILLIC") else "Latin" if name.startswith("LATIN") else "Other"] += 1
    return max(("Latin", "Cyrillic", "Han", "Other"), key=lambda k: found[k]) if found else "Other"


def plain(text, lang, cut, encoding):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    tokens = [t for w in words for t in cut.model.encode(w)]
    counts, n, n2 = Counter(tokens), max(1, len(tokens)), sum(len(encoding.encode_ordinary(" " + w)) for w in words)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    chars = sum(map(len, words))
    base = len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    share = sum(cut.is_byte[t] for t in tokens) / n
    name = lang if lang in quality.BANDS else letters_script(text)
    band = quality.BANDS[name]
    kept = not failed and band.least_chars <= chars / n <= band.most_chars and band.least_chars2 <= chars / max(1, n2) <= band.most_chars2 and share <= band.most_bytes
    kept = kept and (n < band.asked or entropy >= band.least_entropy * math.log2(n))
    return *base, failed, len(tokens), round(chars / n, 9), round(chars / max(1, n2), 9), round(float(share), 9), round(entropy, 6) + 0.0, name, bool(kept)


def check(rows, docs):
    cut, encoding = quality.pieces(vocabulary("piece_bpe_32k.model")), many()
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens, round(r.chars_per_token, 9), round(r.chars_per_token2, 9), round(r.byte_share, 9), round(r.token_entropy, 6), r.band, r.kept) for r in rows]
    want = [(str(d), *plain(t, lang, cut, encoding)) for d, t, lang in docs]
    assert sorted(got) == sorted(want)
    assert all(r.kept == (not r.base_failed and r.rejected_by is None) for r in rows)


def test_op4_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = contracts.op4_tokeniser_fertility(spark, SF).collect()
    check(rows, [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()])
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [r for r in rows if not r.base_failed and r.doc_id in quality_of]
    good, bad = ([r.kept for r in passed if quality_of[r.doc_id] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad) and len(bad) > 20


def test_awkward(spark):
    df = awkward(spark, [(20, "a b c d e f g h i a b c d e f g h\nx\n\nx\n x", "xx", "", 0, "", 0), (21, "да нет " * 40 + "漢字", None, "", 0, "", 0)])
    check(quality.rules(df).collect(), [(r.doc_id, r.text, r.lang) for r in df.collect()])
    assert quality.rules(empty(spark)).count() == 0


def test_bands_reject_bytes_and_single_letters(spark):
    rows = [(1, " ".join(f"w{i} some plain words" for i in range(30))), (2, " ".join(chr(0x13000 + i) for i in range(200))), (3, " ".join(chr(97 + i * 7 % 26) for i in range(500)))]
    kept = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string"), lang_col=None, bands=quality.BANDS | {"Other": quality.Band(0.2, 7, 0.5)}).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_planted_junk_by_band(spark):
    """Menus, symbols stuck to words, scattered letters, few tokens over and over and foreign bytes fall out, each by its measure; prose stays."""
    rng = random.Random(5)
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 600 and 3000").join(good, "doc_id").orderBy("doc_id").collect()][:40]
    words = [w for t in prose for w in t.split() if w.isalpha()]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    junk = {
        "menu": " | ".join(w[:7].title() for w in some(200)), "symbols": " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in some(200)),
        "letters": " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(200)), "few": " ".join(rng.choice(["the", "and", "of", "to", "in", "that"]) for _ in range(400)),
        "bytes": " ".join(chr(rng.randint(0x13000, 0x133FF)) * 3 + " " + rng.choice(words) for _ in range(100)),
    }
    rows = [(k, t, "en") for k, t in junk.items()] + [(f"prose{i}", t, "en") for i, t in enumerate(prose)]
    found = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    assert {k: (found[k].kept, found[k].base_failed) for k in junk} == {k: (False, False) for k in junk}, {k: found[k] for k in junk}
    assert found["few"].rejected_by == "token_entropy" and found["menu"].rejected_by.startswith("chars_per_token") and found["letters"].rejected_by == "chars_per_token"
    assert sum(found[f"prose{i}"].rejected_by is None for i in range(len(prose))) >= 0.9 * len(prose)


def test_measured_bands(spark):
    rows = contracts.op4_tokeniser_fertility(spark, SF)
    found = {r.band: r for r in quality.measured_bands(rows, 0.01).collect()}
    en = sorted(r.chars_per_token2 for r in rows.where("band = 'en' and not base_failed").collect())
    assert found["en"].n == len(en) and abs(found["en"].chars_per_token2[0] - en[len(en) // 100]) < 0.05


def test_very_long_words(spark):
    rows = [(1, "x" * 300_000 + " " + "漢" * 50_000, None), (2, "é" * 1000, None)]
    assert [r.kept for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()] == [False, False]


def test_counts_of_words_together_are_those_of_each_alone():
    rng = random.Random(9)
    letters = [*"abé漢'sS1.,-#$😀ß", "\u3000", "\xa0", "the", "'ll", "\x85"]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(4000)} | {"x" * 1000})
    encoding = many()
    counts = quality.Counts(vocabulary("byte_bpe_multi_50k.tiktoken"))
    want = [len(encoding.encode_ordinary(" " + w)) if len(w) < 256 else counts.alone(w) for w in words]
    assert counts(words).tolist() == want and counts(words).tolist() == want
