"""Token ids in ORC and packing, against the tokenizers library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.helpers import SF, awkward, empty
from tokenizers import Tokenizer

from rillspark.llm import contracts, orcids, packing
from rillspark.llm.vocab import Encoder, encoder, vocabulary

PLAIN = Tokenizer.from_file(vocabulary())


def whole(text):
    """The library's plain call, by a tokenizer of its own."""
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_cache_gives_the_ids_of_whole_texts():
    random.seed(7)
    letters = "ab'sé.,1 \n  \t\r\xa0 　\x1c\x85漢<|endoftext|>'ll 😀"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(vocabulary())(texts)] == [whole(t) for t in texts]


def test_special_strings_as_text():
    plain = Tokenizer.from_file(vocabulary())
    plain.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x"]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocabulary(), specials=False)(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and whole(texts[0]) == [64, 220, 50256, 275]


def check_ids(rows, docs, end):
    want, at = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), end]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_op7_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_ids(contracts.op7_orc_token_ids(spark, SF).collect(), docs, 2)


@pytest.mark.parametrize("piece", [3, 1 << 16])
def test_orc_awkward_pieces_and_pruning(spark, tmp_path, piece):
    df = awkward(spark)
    orcids.write_ids(df, to := f"{tmp_path}/ids", piece_ids=piece)
    rows = orcids.documents_of(orcids.read_ids(spark, to)).collect()
    check_ids(rows, [(r.doc_id, r.text) for r in df.collect()], 2)
    found = orcids.read_ids(spark, to, "doc_id = 5")
    assert found.select("ids").rdd.map(lambda r: len(r.ids)).sum() == len(whole("word " * 30_000)) + 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in found._jdf.queryExecution().toString()


def test_orc_empty(spark, tmp_path):
    orcids.write_ids(empty(spark), to := f"{tmp_path}/ids")
    assert orcids.documents_of(orcids.read_ids(spark, to)).count() == 0


def check_packed(rows, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_row, r.sequence_id >> 40].append(r)
        sequences[r.sequence_id].append(r)
    got = []
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) > 0 and r.ids_crc32 == crc(r.ids) for r in own)
        got.append((own[0].doc_id, ids))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((d, [*whole(t), 0]) for d, t in docs), key=key)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= 1024 and total & (total - 1) == 0 and len({(r.tier, r.step_group) for r in own}) == 1


@pytest.mark.parametrize("held", [2000, packing.HELD_TOKENS])
def test_packing_awkward(spark, held):
    df = awkward(spark)
    check_packed(packing.pack(df, held_tokens=held).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert packing.pack(empty(spark)).count() == 0


def test_packing_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(df).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in df.collect()])
    long = sum(r.length for r in rows if r.tier >= 128)
    assert long > 0.99 * sum(r.length for r in rows)
    steps = defaultdict(int)
    for r in rows:
        steps[r.step_group] += r.length
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_op9_query(spark, tmp_path):
    """The registered query over a table with awkward rows and control strings, its pieces against the library's ids."""
    docs = [(i, t) for i, t in enumerate(["a <|endoftext|> b", None, "", "word " * 3000, "same", "same", "é 漢 😀 " * 700])]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in contracts.op9_hierarchical_packing(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids, at = [*whole(text), 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert (total := sum(r.length for r in own)) <= 1024 and total & (total - 1) == 0
    assert len(pieces) == len(docs)
