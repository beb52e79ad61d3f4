"""Chunked media against plain Python, exact round trips, and chunks that survive an insertion."""

import bz2
import hashlib
import math
import random
import zlib

from tests.llm.helpers import SF, awkward, empty

from rillspark.llm import contracts, media


def plain(text):
    data = (text or "").encode()
    padded = data + bytes(-len(data) % 64 or (0 if data else 64))
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def form(text, cutter):
    """What is stored of a text: its compressed chunks in order, by the cutter's ends; and the features of its payload."""
    data = media.payload(text)[1]
    ends = cutter.ends(data)
    stored = b"".join(bz2.compress(data[a:z]) for a, z in zip([0, *ends], ends))
    share = [data.count(bytes([b])) / len(data) for b in set(data)]
    entropy = -sum(p * math.log2(p) for p in share)
    return len(stored), hashlib.sha256(stored).hexdigest(), len(ends), len(share), entropy


def check_form(rows, docs, cutter):
    text_of = {}
    for d, t in docs:
        text_of[plain(t)[2]] = t
    for r in rows:
        size, digest, chunks, symbols, entropy = form(text_of[r.payload_sha256], cutter)
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert (r.media_bytes, r.media_sha256, int(parts["chunks"]), int(parts["symbols"])) == (size, digest, chunks, symbols)
        assert abs(float(parts["entropy"]) - entropy) < 1e-4


def check(rows, docs):
    key = lambda r: tuple(map(str, r[:5]))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(((d, *plain(t)) for d, t in docs), key=key)
    assert all(r.verified for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, tuple(r)[1:]) == tuple(r)[1:]


def test_op3_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = contracts.op3_chunked_media(spark, SF).collect()
    check(rows, docs)
    check_form(rows, docs, media.Cutter())


def test_awkward_and_round_trip(spark):
    df = awkward(spark, [(50, "x" * 64, "", "", 64, "", 0), (51, "".join(map(chr, range(40, 9000))) * 20, "", "", 0, "", 0)])
    stored = media.write(df, cutter=media.Cutter(64, 6, 512))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(media.read_back(stored).collect(), docs)
    check_form(media.read_back(stored).collect(), docs, media.Cutter(64, 6, 512))
    got = sorted((str(r.doc_id), bytes(r.payload)) for r in media.payloads(stored).collect())
    assert got == sorted((str(d), media.payload(t)[1]) for d, t in docs)
    assert stored.store.count() == stored.store.select("digest").distinct().count()
    assert media.read_back(media.write(empty(spark))).count() == 0


def test_cuts_follow_content():
    rng = random.Random(5)
    data = bytes(rng.choices(range(256), k=400_000))
    cutter = media.Cutter(256, 10, 8192)

    def chunks(x):
        ends = cutter.ends(x)
        assert b"".join(x[a:z] for a, z in zip([0, *ends], ends)) == x
        assert all(256 <= z - a <= 8192 for a, z in zip([0, *ends][:-2], ends[:-1]))
        return {x[a:z] for a, z in zip([0, *ends], ends)}

    moved = chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(chunks(data) - moved) <= 3
    gear = media._gear().tolist()
    h, at, want = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        if (i + 1 - at >= 256 and h >> 22 == 0) or i + 1 - at == 8192:
            at = i + 1
            want.append(at)
    assert cutter.ends(data) == want + ([len(data)] if at < len(data) else [])
