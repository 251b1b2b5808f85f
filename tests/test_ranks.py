"""Quantiles, AUROC and bootstrap AUROC of groups that no single task holds, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import metrics, resample


def records(spark, n, seed=0, ties=False):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = float(r.normal()) if not ties else float(r.integers(0, 6))
        rows.append((None if i % 11 == 0 else int(i % 3 > 0), int(r.integers(0, 25)), v if i % 17 else None, bool(r.random() < 0.3), "x" if i % 2 else "y"))
    return spark.createDataFrame(rows, "g int, sim long, score double, label boolean, detector string").repartition(7)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 0.9871, 1.0])
@pytest.mark.parametrize("n, ties", [(1, False), (40, False), (6000, False), (6000, True)])
def test_quantile_is_percentile(spark, n, ties, q):
    df = records(spark, n, ties=ties)
    for keys in ([], ["g"]):
        got = sorted(map(repr, metrics.quantile(df, keys, "score", q, "v").collect()))
        want = df.where("score is not null").groupBy(*keys).agg(F.percentile("score", F.lit(q)).alias("v")) if keys or n > 1 else df.where("score is not null").groupBy(F.lit(1)).agg(F.percentile("score", F.lit(q)).alias("v")).select("v")
        assert got == sorted(map(repr, want.collect()))


def test_quantile_reads_a_bracket_only(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.rand(3).alias("score"))
    metrics.quantile(df, ["g"], "score", 0.95).collect()
    plan = metrics.quantile(df, ["g"], "score", 0.95)._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "percentile(" not in plan.replace("percentile_approx(", "")


def plain_auroc(label, score, weight=None):
    weight = np.ones(len(label)) if weight is None else weight
    won = total = 0.0
    for i in np.flatnonzero(label):
        d = np.sign(score[i] - score[~label])
        won += weight[i] * (weight[~label] * (d + 1) / 2).sum()
        total += weight[i] * weight[~label].sum()
    return won / total if total else None


def test_auroc_over_many_ranges(spark):
    df = records(spark, 3000).where("score is not null").fillna(7, ["g"]).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.repartitionByRange("g", "score").select(F.spark_partition_id()).distinct().count() > 2
        got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    p = df.toPandas()
    for g, own in p.groupby("g"):
        assert got[g] == pytest.approx(plain_auroc(own.label.to_numpy(), own.score.to_numpy()), rel=1e-12)


@pytest.mark.parametrize("cells", [1 << 24, 80])
@pytest.mark.parametrize("ties", [False, True])
def test_weighted_auroc(spark, monkeypatch, cells, ties):
    monkeypatch.setattr(resample, "MATRIX", cells)  # 80: three replicates a block
    monkeypatch.setattr(resample, "CHUNK", 5)
    df = records(spark, 400, 4, ties).where("score is not null").cache()
    weights = resample.bootstrap_weights(df, 10).cache()
    drawn = {(r["rep"], r["sim"]): r["weight"] for r in weights.collect()}
    p = df.toPandas()
    for keys in ([], ["detector"]):
        got = {tuple(r)[:-1]: r["auroc"] for r in resample.weighted_auroc(df, weights, keys, 10).collect()}
        groups = [((), p)] if not keys else [((k,), own) for k, own in p.groupby("detector")]
        assert len(got) == 10 * len(groups)
        for k, own in groups:
            for rep in range(10):
                w = np.array([drawn.get((rep, s), 0) for s in own.sim], float)
                assert got[(*k, rep)] == pytest.approx(plain_auroc(own.label.to_numpy(), own.score.to_numpy(), w), rel=1e-12)


def test_family_against_each_cells_own_baseline(spark):
    r = np.random.default_rng(0)
    rows = [(s, f, "t", sev, bool(lab), d, float(lab * gain[sev] + r.normal())) for gain, d in (({1: 1.0, 2: 0.2}, "a"), ({1: 0.2, 2: 1.0}, "b"), ({1: 2.0, 2: 2.0}, "v")) for s in range(25) for f in range(6) for sev in (1, 2) for lab in (0, 1)]
    df = spark.createDataFrame(rows, "sim long, frame int, type string, sev int, label boolean, detector string, score double")
    cells = metrics.cell_metrics(df.withColumn("phase", F.when(F.col("label"), "sustained").otherwise("clean")))
    best = metrics.best_baselines(cells, ["a", "b"])
    assert {x["sev"]: x["detector"] for x in best.collect()} == {1: "a", 2: "b"}
    deltas = resample.family_deltas(df, "v", best, ["type", "sev"], 200)
    one = resample.gate_mean_diff(deltas).first()
    own = metrics.auroc(df, ["type", "sev", "detector"]).toPandas().set_index(["sev", "detector"]).auroc
    assert one["passed"] and abs(one["mean"] - ((own[1, "v"] - own[1, "a"]) + (own[2, "v"] - own[2, "b"])) / 2) < 0.02
