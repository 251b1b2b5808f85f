import pytest
from pyspark.sql import functions as F

from trajscreen.operators import detect, mesh
from trajscreen.plans.fixtures import view
from trajscreen.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bucketed(spark):
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    p = view(spark, SF, "positions").where("sim <= 6")
    tables.write_runs(p, "runs_bucketed", 4)
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield p, spark.table("runs_bucketed")
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.sql("DROP TABLE runs_bucketed")


def rows(df):
    return sorted((r.sim, r.frame, r.node, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("detector", ["constvel", "residual", "velocity", "velocity_causal", "laplacian", "vlap"])
def test_no_exchange_above_the_scan(spark, bucketed, detector):
    nodes, edges = F.broadcast(view(spark, SF, "rest")), F.broadcast(spark.createDataFrame(mesh.mesh_edges(view(spark, SF, "cells")).collect()))
    run = {
        "constvel": detect.constvel_scores,
        "residual": lambda p: detect.residual_scores(p, p.select("sim", "frame", "node", *[(F.col(c) * 0).alias(f"a{c}") for c in "xyz"])),
        "velocity": detect.velocity_scores,
        "velocity_causal": detect.velocity_causal_scores,
        "laplacian": lambda p: detect.laplacian_scores(p, nodes, edges),
        "vlap": lambda p: detect.velocity_laplacian_scores(p, edges),
    }[detector]
    plain, stored = bucketed
    scores = run(stored)
    assert "hashpartitioning" not in scores._jdf.queryExecution().executedPlan().toString()
    assert rows(scores) == rows(run(plain))
