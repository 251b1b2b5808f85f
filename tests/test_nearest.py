import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import answers


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def brute(q, b, k, cosine):
    if cosine:
        q, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, b))
        d = 1 - q @ b.T
    else:
        d = np.linalg.norm(q[:, None] - b[None], axis=2)
    return np.sort(d, axis=1)[:, :k]


def checked(spark, q, b, k, cosine, **parameters):
    got = {r.vec_id: r.distances for r in answers.nearest_in_bank(table(spark, q), table(spark, b, 10_000), k, cosine, **parameters).collect()}
    want = brute(q, b, k, cosine)
    assert len(got) == len(q)
    assert all(got[i] == pytest.approx(w.tolist(), abs=2e-6) for i, w in enumerate(want))


@pytest.mark.parametrize(("k", "cosine", "held"), [(3, False, 0), (1, True, 0), (3, False, 1 << 20), (1, True, 1 << 20), (400, False, 0)])
def test_equal_to_brute_force(spark, k, cosine, held):
    rng = np.random.default_rng(5)
    checked(spark, rng.normal(size=(300, 6)), rng.normal(size=(300, 6)), k, cosine, rows=20, held=held)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    b = np.concatenate([np.tile(rng.normal(size=(1, 4)), (150, 1)), rng.normal(size=(50, 4))])  # most of the bank is one row
    checked(spark, b[100:180], b, 5, False, rows=20, held=0)


def test_fewer_rows_than_pivots(spark):
    rng = np.random.default_rng(7)
    checked(spark, rng.normal(size=(5, 3)), rng.normal(size=(2, 3)), 4, False, rows=2, held=0)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_empty_sides(spark, held):
    some, none = table(spark, np.ones((2, 3))), table(spark, np.ones((0, 3)))
    assert answers.nearest_in_bank(some, none, 2, False, held=held).count() == 0
    assert answers.nearest_in_bank(none, some, 2, False, held=held).count() == 0


def test_far_shards_are_not_compared(spark):
    rng = np.random.default_rng(8)
    centres = 100 * rng.normal(size=(12, 5))
    q, b = (np.repeat(centres, n, axis=0) + rng.normal(size=(12 * n, 5)) for n in (10, 200))
    pivots = b[::50]
    own, shards = answers.shards_of(answers._vectors(table(spark, b), False), pivots, 100)
    sizes = dict(own.groupBy("shard").count().collect())
    assert sum(sizes.values()) == len(b) and max(sizes.values()) <= 100
    chosen = answers.candidate_shards(answers._vectors(table(spark, q), False), pivots, shards, 3).select(F.explode("shards").alias("s")).collect()
    assert sum(sizes[r.s] for r in chosen) < 0.15 * len(q) * len(b)
