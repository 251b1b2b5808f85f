"""Queries that work run by run move no rows of runs once the runs are made, and a task's share of them is bounded."""

import re

import pytest

from trajscreen.operators import runs
from trajscreen.plans import registry

SF = "/root/testdata/sf0.001"
BY_RUN = ["d5_vlap_scores", "d8_jacobian_scores", "j2_world_edges", "j8_signed_distance", "r2_contact_run_stats"]


@pytest.mark.parametrize("name", BY_RUN)
def test_no_step_moves_rows_of_runs(spark, monkeypatch, name):
    plans, stored = [], runs.stored
    monkeypatch.setattr(runs, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    monkeypatch.setattr(runs, "DEALT", 1000)
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(n) for n in names]
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert [spark.conf.get(n) for n in names] == before
    (plan,) = plans
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    moved = re.findall(r"Exchange (?:hash|range)partitioning\(sim.*", plan)
    assert moved and all(f", {tasks}), REPARTITION_BY_NUM" in x for x in moved)  # runs are dealt, 1,000 rows a task
