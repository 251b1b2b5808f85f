"""The bundle's features are made where the runs lie."""

import re

from trajscreen.operators import detect, runs
from trajscreen.plans import registry

SF = "/root/testdata/sf0.001"


def test_no_step_moves_rows_of_runs(spark, monkeypatch):
    plans, stored, kept = [], runs.stored, detect.kept
    seen = lambda f: lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df)
    monkeypatch.setattr(runs, "stored", seen(stored))
    monkeypatch.setattr(detect, "kept", seen(kept))
    monkeypatch.setattr(runs, "DEALT", 1000)
    assert registry.QUERIES["d13_bundle_features"](spark, SF).count() > 0
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    moved = [x for plan in plans for x in re.findall(r"Exchange (?:hash|range)partitioning\(.*", plan) if "sim#" in x]
    assert len(plans) == 5 and moved and all(re.search(rf"partitioning\(sim#\w+, {tasks}\), REPARTITION_BY_NUM", x) for x in moved)
