"""Copies, their scores and their diagnoses are made where the runs lie: no table between the deal and the result moves rows of runs."""

import re

import pytest

from trajscreen.operators import runs
from trajscreen.plans import registry

SF = "/root/testdata/sf0.001"
HELD = ["i13_sparse_copy_scores", "x6_diagnostics"]


@pytest.mark.parametrize("name", HELD)
def test_no_table_moves_rows_of_runs(spark, monkeypatch, name):
    plans, stored = [], runs.stored
    monkeypatch.setattr(runs, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    monkeypatch.setattr(runs, "DEALT", 1000)
    assert registry.QUERIES[name](spark, SF).count() > 0
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    moved = [x for x in re.findall(r"Exchange (?:hash|range)partitioning\(.*", plans[0]) if "sim#" in x]  # with the plans of all that was held
    assert moved and all(re.search(rf"partitioning\(sim#\w+, {tasks}\), REPARTITION_BY_NUM", x) for x in moved)
