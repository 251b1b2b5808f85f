"""Multiclass boosting over counted combinations of bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import boosting


def loss(score, counts):
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return -(counts * np.log(p)).sum() / counts.sum()


def test_one_split_by_hand():
    bins, counts = np.array([[1], [2], [3]]), np.array([[30.0, 0.0], [30.0, 0.0], [0.0, 60.0]])
    first, feature, bound, value = boosting.boosted(bins, counts, 1, 1, 1.0, 20.0)
    assert np.allclose(first, np.log(0.5)) and bound[0, 0, 0] == 2 and feature[0, 0, 0] == 0
    # left: 60 rows, gradient 60 * 0.5 - 60, curvature 60 * 0.25; right: the opposite
    assert value[0, 0] == pytest.approx([2.0, -2.0], rel=1e-6)
    whole = boosting.boosted(bins, counts, 1, 1, 1.0, 61.0)
    assert (whole[2] == boosting.BINS).all()  # no cut leaves 61 rows on both sides


def test_loss_falls_and_repeated_cells_count():
    r = np.random.default_rng(0)
    bins = r.integers(0, 20, size=(300, 3))
    truth = (bins[:, 0] > 9).astype(int) + (bins[:, 1] > 14)
    counts = np.eye(3)[truth] * r.integers(1, 30, size=(300, 1))
    losses = [loss(boosting.logits(bins, *boosting.boosted(bins, counts, n, 3, 0.1, 5.0)), counts) for n in (1, 10, 60)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1
    each = np.repeat(np.arange(300), counts.sum(axis=1).astype(int))
    one = boosting.boosted(bins[each], np.eye(3)[truth[each]], 5, 3, 0.1, 5.0)
    together = boosting.boosted(bins, counts, 5, 3, 0.1, 5.0)
    assert np.allclose(boosting.logits(bins, *one), boosting.logits(bins, *together))


def test_rows_are_fitted_and_predicted_in_tasks(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        k = ("none", "late", "press")[i % 3]
        a, b = r.normal({"none": 0, "late": 3, "press": 3}[k]), r.normal({"none": 0, "late": 0, "press": 3}[k])
        rows.append((i, k, None if i % 50 == 0 else float(a), float(b)))
    df = spark.createDataFrame(rows, "i long, kind string, `a.x` double, b double").repartition(5)
    model = boosting.fit(df.where("i % 2 = 0"), ["a.x", "b"], "kind", rounds=60)
    assert model.labels == ["late", "none", "press"]
    out = boosting.with_logits(model, df.where("i % 2 = 1"), "z").withColumn("pred", F.element_at(F.array(*[F.lit(x) for x in model.labels]), F.array_position("z", F.array_max("z")).cast("int")))
    assert out.agg(F.avg((F.col("pred") == F.col("kind")).cast("double"))).first()[0] > 0.85
    again = boosting.fit(df.where("i % 2 = 0").repartition(2), ["a.x", "b"], "kind", rounds=3)
    assert np.array_equal(again.value[:3], model.value[:3])


def test_more_cells_than_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CELLS", 60)
    df = spark.range(2000).select((F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") % 40 < 20, "x").otherwise("y").alias("kind"))
    model = boosting.fit(df, ["a", "b"], "kind", rounds=5, least=1.0)
    assert model.labels == ["x", "y"] and model.value.shape == (5, 2, 16)
