"""Mixing against DuckDB, against plain highest quotients, and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SF, awkward, empty
from tests.oracle import actual, expected

from rillspark.llm import contracts, mixing


def test_op8_matches_sql(spark):
    assert actual(contracts.op8_sainte_lague_mix(spark, SF)) == expected(SF, mixing.SQL)


def plain_seats(aims, n, bounds):
    seats = dict.fromkeys(aims, 0)
    for _ in range(min(n, sum(bounds.values()))):
        best = max((p for p in aims if seats[p] < bounds[p]), key=lambda p: (aims[p] / (2 * seats[p] + 1), -p))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("seed", range(3))
def test_seats_are_those_of_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    sizes = [("s%02d" % i, rng.choice([0, 3, 40, 500, 7000, 20_000]) + rng.randint(0, 9)) for i in range(rng.choice([2, 7, 25]))]
    aims = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).cache()
    rows = {r.place: r for r in aims.collect()}
    assert abs(sum(r.target for r in rows.values()) - sum(s for _, s in sizes)) < 1e-3
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in rows.values())
    free = [r.target / r.weight for r in rows.values() if r.target < 3 * r.source_size - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(free)
    got = {}
    for r in mixing.apportion(aims, 16, 8).collect():
        got.setdefault(r.shard, {})[r.place] = r.seats
    total = sum(s for _, s in sizes) // 16
    for shard, seats in got.items():
        assert seats == plain_seats({p: r.target for p, r in rows.items()}, shard * total // 8, {p: r.source_size * 3 // 16 for p, r in rows.items()})


def test_awkward(spark):
    made = mixing.mix(awkward(spark, [(100 + i, "a b c d e f g h " * i, "en", "b", 0, "", 0) for i in range(60)]))
    rows = made.documents.collect()
    assert len(rows) == 69 and all(0 <= r.taken <= 3 * r.size for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 + 1 for s in taken)
    quotas = made.quotas.groupBy("shard").agg(F.sum("blocks").alias("n"), F.min("blocks").alias("least")).collect()
    assert max(r.n for r in quotas) - min(r.n for r in quotas) <= 1 and min(r.least for r in quotas) >= 0
    assert mixing.mix(empty(spark)).documents.count() == 0 and mixing.mix(empty(spark)).quotas.count() == 0
