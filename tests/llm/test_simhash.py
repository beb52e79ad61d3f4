"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from tests.llm.helpers import SF, awkward, empty

from rillspark.llm import common, contracts, simhash
from rillspark.llm.graph import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs, most=2):
    prints = [brute_print(t) for _, t in docs]
    fps = np.array(prints, np.uint64)
    near = [np.nonzero(np.bitwise_count(fps ^ f) <= most)[0] for f in fps]
    out, seen = [], {}
    for i in range(len(docs)):
        if i in seen:
            continue
        todo, own = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in own:
                    own.add(int(j))
                    todo.append(int(j))
        least = min((docs[j][0] for j in own if docs[j][0] is not None), default=None)
        seen |= dict.fromkeys(own, least)
    return sorted(((d, f"{p:016x}", seen[i]) for i, ((d, _), p) in enumerate(zip(docs, prints))), key=str)


def test_op10_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, contracts.op10_simhash_components(spark, SF).collect()), key=str) == brute(docs)


def test_awkward(spark):
    df = awkward(spark)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("wide", [2, 256])
def test_links_of_crowded_prints(spark, monkeypatch, wide):
    """Prints that crowd together, so that postings are large, against all pairs."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(12), rng.randint(0, 6))) for b in base for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    rows = components(simhash._links(df, 2)).collect()
    root = {r.node: r.root for r in rows}
    signed = fps.view(np.int64).tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    groups = {}
    for f, l in zip(signed, label.tolist()):
        groups.setdefault(l, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set(map(min, groups.values()))) == len(groups)
    if wide == 2:  # the route for large postings, by itself
        monkeypatch.setattr(simhash, "WIDE", wide)
        own = np.unique(np.array([f & ((1 << 12) - 1) for f in fps.tolist()], np.uint64))
        got = simhash._roots(own, 2, np.arange(16))
        monkeypatch.setattr(simhash, "WIDE", 1 << 30)
        assert (got == simhash._roots(own, 2, np.arange(16))).all()


def test_repeats_of_a_line_do_not_hide_a_similar_text(spark):
    """Texts of equal shingle sets, but for the join, whose line is repeated once and 20 times."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows = []
    for i in range(12):
        base, line = [word() for _ in range(200)], [word() for _ in range(8)]
        rows += [(2 * i, " ".join(base + line)), (2 * i + 1, " ".join(base + line * 20))]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [2 * i for i in range(12)]


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def star(n=300, n_words=200, edits=4, seed=6):
    """A text and n edited copies of it, each similar to it, few to each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(n_words)]
    texts = [" ".join(base)]
    while len(texts) <= n:
        copy = list(base)
        for i in rng.sample(range(n_words), edits):
            copy[i] = word()
        if jaccard(shingle_set(texts[0]), shingle_set(" ".join(copy))) >= 0.8:
            texts.append(" ".join(copy))
    return texts


def groups_of(texts):
    """The least number of each text's group, by brute force over all pairs."""
    sets, root = [shingle_set(t) for t in texts], np.arange(len(texts))
    edges = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in range(len(texts)):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_a_star_of_edited_copies_is_one_group(spark):
    texts = star()
    left = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in left.collect()) == np.unique(groups_of(texts)).tolist() == [0]


def test_long_postings_keep_those_that_lead():
    """A posting that is led in steps, as far as its nodes are near any and the rest go on to, against one that is led at once."""
    texts = star(120, seed=9)
    prints = simhash.samples(texts, 64, 5)
    lead, _ = simhash._led(prints, 38)
    assert (simhash._tally(prints, lead, np.arange(len(lead))) >= 38).all()
    leads = np.unique(lead)
    assert (simhash._tally(prints, leads[:, None], leads[None, :]) < 38)[~np.eye(len(leads), dtype=bool)].all()


def test_postings_led_in_steps(spark, monkeypatch):
    texts = star(200, seed=12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    held = simhash.HELD
    monkeypatch.setattr(simhash, "HELD", 24)
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(common, "BATCH_ROWS", 10)
    left = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    assert held > 24 and left == np.unique(groups_of(texts)).tolist() == [0]


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    left = simhash.one_of_each(spark.read.parquet(f"{SF}/documents.parquet"))
    want = groups_of([r.text for r in rows])
    assert sorted(r.doc_id for r in left.collect()) == [rows[i].doc_id for i in np.unique(want).tolist()]


def edited(seed, n, share):
    """n texts of 40 to 300 words, and for each one with some words changed, as near as `share` of shingles or a little nearer."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    out = []
    for _ in range(n):
        a = [word() for _ in range(rng.randint(60, 300))]
        b, own, before = list(a), shingle_set(" ".join(a)), None
        while jaccard(own, shingle_set(" ".join(b))) >= share:
            before = list(b)
            b[rng.randrange(len(b))] = word()
        out.append((" ".join(a), " ".join(before)))
    return out


@pytest.mark.parametrize(("key_bytes", "posting"), [(5, 1), (2, 1), (1, 10), (1, 100)])
def test_recall_at_growing_postings(spark, key_bytes, posting):
    """Pairs at a similarity of 0.8 are candidates however many unrelated texts share their postings, and nothing unrelated is."""
    pairs = edited(7, 150, 0.8)
    rng = np.random.default_rng(3)
    prints = simhash.samples([t for p in pairs for t in p], 64, 5)
    noise = rng.integers(0, 256, (posting * 256 if key_bytes == 1 else 256, 64), np.uint8)
    rows = [(i.to_bytes(16, "big"), p.tobytes()) for i, p in enumerate(np.concatenate((prints, noise)))]
    found = simhash._candidates(spark.createDataFrame(rows, "node binary, print binary"), simhash.position_choices(64, key_bytes, 20 if key_bytes > 1 else 12), 64, 38)
    got = {tuple(sorted(int.from_bytes(x, "big") for x in r[:2])) for r in found.select("a", "b").collect()}
    true = {(2 * i, 2 * i + 1) for i in range(150)}
    assert len(got & true) >= 147 and not any(a < 300 <= b or a >= 300 for a, b in got)


def test_no_pair_of_a_posting_is_lost_among_a_thousand_others(spark):
    pairs = edited(17, 150, 0.8)
    prints = simhash.samples([t for p in pairs for t in p], 64, 5)
    noise = np.random.default_rng(4).integers(0, 256, (64 * 1000, 64), np.uint8)
    every = np.concatenate((prints, noise))
    every[:, 0] %= 64
    df = spark.createDataFrame([(i.to_bytes(16, "big"), p.tobytes()) for i, p in enumerate(every)], "node binary, print binary")
    got = {tuple(sorted(int.from_bytes(x, "big") for x in r[:2])) for r in simhash._candidates(df, [(0,)], 64, 38).select("a", "b").where("a <> b").collect()}
    a, b = every[:300:2], every[1:300:2]
    assert got == {(2 * i, 2 * i + 1) for i in range(150) if a[i, 0] == b[i, 0] and (a[i] == b[i]).sum() >= 38} and len(got) > 100


def test_samples_share_bytes_by_similarity():
    for share in (0.8, 0.9):
        pairs = edited(11, 60, share)
        a, b = simhash.samples([p[0] for p in pairs], 64, 5), simhash.samples([p[1] for p in pairs], 64, 5)
        real = np.mean([jaccard(shingle_set(x), shingle_set(y)) for x, y in pairs])
        assert abs((a == b).mean() - (real + (1 - real) / 256)) < 0.02
    texts = ["", " \t", "one two", "One  TWO", "one two three four five six"]
    s = simhash.samples(texts, 64, 5)
    assert not s[:2].any() and (s[2] == s[3]).all() and (simhash.samples(texts[::-1], 64, 5)[::-1] == s).all()


def test_awkward_texts_keep_one_of_each(spark):
    df = awkward(spark)
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 5, 7, None]
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_components_of_any_node_type(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500, i) for i in range(501, 700)]
    root = list(range(700))
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: root[i] for e in edges if e[0] != e[1] for i in e}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    as_bytes = spark.createDataFrame([(a.to_bytes(16, "big"), b.to_bytes(16, "big")) for a, b in edges], "a binary, b binary")
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(as_bytes).collect()} == want
