"""The factorization machine: pairs that additive weights can't tell, held-out accuracy, gradients, and awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, empty
from tests.llm.test_passages import prose

from rillspark.llm import contracts, toxicity


def corpus(n, seed=3):
    """Toxic if an insult meets a group's name, not by either alone."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(rng.randint(20, 80), rng)
        a, b = rng.random() < 0.4, rng.random() < 0.4
        if a:
            words.insert(rng.randint(0, len(words)), rng.choice(["Vorkle,", "vorkle", "vorklish"]))
        if b:
            words.insert(rng.randint(0, len(words)), rng.choice(["zamites", "zamite."]))
        rows.append((i, " ".join(words), int(a and b)))
    return rows


def test_pairs_of_terms_are_learnt(spark):
    rows = corpus(1500)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    truth = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score(docs, machine).collect()}
    assert sum(got[i] == bool(y) for i, y in truth.items()) >= 0.97 * len(truth)
    assert np.abs(machine.v).max() > 0.2
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert (again.hashes == machine.hashes).all() and np.allclose(again.w, machine.w) and again.bias == machine.bias


def test_held_out_rows_are_not_read(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(r[0], r[2]) for r in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.hashes == b.hashes).all() and (a.w == b.w).all() and a.bias == b.bias


def test_the_bound_on_rows_holds(spark):
    rows = corpus(300)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, rows=50).hashes) <= len(toxicity.fit(docs, labels).hashes)


def test_an_id_with_very_many_texts_is_bounded(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, f"said {i} times over") for i in range(500)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machines = [toxicity.fit(d, labels, rows=40, evidence=0.0) for d in (docs, docs.repartition(7))]
    assert (machines[0].hashes == machines[1].hashes).all() and np.allclose(machines[0].w, machines[1].w)
    known = {h for t in ("said", "times", "over") for h in toxicity.terms(t)}
    assert 0 < len(machines[0].hashes) < 40 * 200 and known & set(machines[0].hashes.tolist())


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)), 0.4)
    ids = np.array([0, 2, 5])
    want = 0.4 + m.w[ids].sum() + sum(m.v[i] @ m.v[j] for i in ids for j in ids if i < j)
    assert np.allclose(m.margin(np.array([1, 1, 1]), ids, 2)[0], [0.4, want])


@pytest.mark.parametrize("labels", ["some", "none"])
def test_awkward(spark, labels):
    df = awkward(spark)
    known = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (5, None), (None, 1), (6, 0), (99, 1)] if labels == "some" else [], "doc_id long, toxic int")
    machine = toxicity.fit(df, known)
    scored = toxicity.score(df.withColumn("score0", F.lit(1)), machine)
    found = scored.collect()
    assert len(found) == 9 and all(0 <= r.score <= 1 for r in found) and scored.columns[:-1] == [*df.columns, "score0"]
    assert toxicity.score(empty(spark), machine).count() == 0
    assert toxicity.without_toxic(df, machine, 1.1).columns == df.columns and toxicity.without_toxic(df, machine, 1.1).count() == 9
    with pytest.raises(ValueError, match="column already"):
        toxicity.score(df, machine, name="lang")


def test_op2_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = contracts.op2_factorization_machine(spark, d)
    found = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in found)
    assert hits >= 0.8 * sum(r.toxic for r in found) and hits >= 0.9 * sum(r.predicted for r in found)
    assert {r.doc_id for r in rows.where("held_out").limit(200).collect()} <= {i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert rows.count() == 10_000
