"""The pipeline stage by stage against brute force, on a small corpus with planted cases."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, empty
from tests.llm.test_passages import prose

from rillspark.llm import mixing, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def near_copies(rng, n=60):
    """Texts with edited copies whose shingle similarity spreads around 0.8."""
    texts = []
    for _ in range(n):
        base = prose(rng.randint(60, 250), rng)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            made = list(base)
            for i in rng.sample(range(len(made)), rng.randint(0, max(1, len(made) // 50))):
                made[i] = "edited" + str(rng.randint(0, 99))
            texts.append(" ".join(made))
    return texts


def test_near_duplicate_groups_against_all_pairs(spark):
    rng = random.Random(8)
    texts = near_copies(rng)
    near = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in near:
        a, b = (root[x] for x in (i, j))
        root = [min(a, b) if r in (a, b) else r for r in root]
    want = set(root)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == want and len(near) > 40, (len(want), len(got), len(near))


def test_one_of_each_awkward(spark):
    df = awkward(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 5, 7, None]))  # texts without words are one group
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_mixed_documents_add_up(spark):
    df = awkward(spark, [(100 + i, "a  b c\nd e f g h " * (i % 7 + 1), "en", "abc"[i % 3], 0, "", 0) for i in range(80)])
    taken = mixing.mix(df).documents.groupBy("source").agg(F.sum("taken").alias("n")).collect()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in taken if r.n} == {r.source: r.n for r in words}
    texts = {r.text for r in df.collect()}
    assert all(any(t is not None and t.startswith(r.text) for t in texts) for r in out.collect())
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(6)
    passage = " ".join(prose(70, rng))
    insult, group = "vorkle", "zamites"
    rows = []
    for i in range(400):
        words = prose(rng.randint(60, 160), rng)
        if i % 5 == 0:
            words.insert(rng.randint(0, 40), insult)
        if i % 3 == 0:
            words.insert(rng.randint(0, 40), group)
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    toxic = {i for i in range(400) if i % 15 == 0}
    shared = [i for i in range(7, 90, 20) if i not in toxic]
    for i in shared:
        rows[i] = (i, rows[i][1] + " " + passage, *rows[i][2:])
    copies = {400: 1, 401: 1, 402: 4}
    rows += [(i, rows[of][1], "en", "s1", 0) for i, of in copies.items()] + [(403, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    left = {r.doc_id for r in kept["toxicity"]}
    # the pair is toxic, neither word alone: a few of either kind may be missed
    assert len(left & toxic) <= 0.15 * len(toxic) and len(set(range(404)) - left - toxic) <= 0.05 * 404
    assert {r.doc_id for r in kept["near_duplicates"]} == left - {i for i, of in copies.items() if of in left}
    assert sum(passage in (r.text or "") for r in kept["near_duplicates"]) == len(set(shared) & left)
    assert sum(passage in (r.text or "") for r in kept["passages"]) == 1
    words = Counter()
    for r in kept["mixing"]:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] / sum(words.values()) - w / 13) < 0.01 for s, w in zip(["s0", "s1", "s2", "s3"], (5, 2, 1, 5)))
    pieces = defaultdict(int)
    for r in kept["packing"]:
        pieces[r.sequence_id] += r.length
    assert max(pieces.values()) <= 1024 and all(n & (n - 1) == 0 for n in pieces.values())


def test_pipeline_on_empty_tables_and_awkward_rows(spark, tmp_path):
    for name, df in (("none", empty(spark)), ("odd", awkward(spark))):
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()  # without labels nothing is known to be toxic
    assert {r.doc_id for r in rows} >= {5, 7} and max(r.length for r in rows) <= 1024
