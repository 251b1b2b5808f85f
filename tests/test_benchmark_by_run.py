"""The frame benchmark and the diagnostic tree are made where the runs lie, a part of the runs after the other."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajscreen.operators import copies, detect, inject, metrics, runs
from trajscreen.plans import injected, registry, screening
from trajscreen.plans.fixtures import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["e1_frame_benchmark", "t6_diagnostic_tree"])
def test_no_table_of_copies_moves_rows_of_runs(spark, monkeypatch, name):
    plans, once = [], {"stored": runs.stored, "kept": copies.kept}
    seen = lambda f: lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df)
    monkeypatch.setattr(runs, "stored", seen(once["stored"]))
    for module in (injected, copies):
        monkeypatch.setattr(module, "kept", seen(once["kept"]))
    monkeypatch.setattr(runs, "DEALT", 1000)
    assert registry.QUERIES[name](spark, SF).count() > 0
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    moved = [x for plan in plans for x in re.findall(r"Exchange (?:hash|range)partitioning\(.*", plan) if "sim#" in x]
    assert len(plans) > 8 and moved and all(re.search(rf"partitioning\(sim#\w+, {tasks}\), REPARTITION_BY_NUM", x) for x in moved)


def test_parts_of_the_runs_make_the_whole(spark, monkeypatch):
    made, stored = [], runs.stored
    monkeypatch.setattr(runs, "stored", lambda df: made.append(df) or stored(df))
    job = lambda p, r, c: detect.frame_scores(detect.constvel_scores(p), r)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(screening.by_run(spark, SF, job))
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert rows(screening.by_run(spark, SF, job, n // 3 + 1)) == whole
    assert len(made) == 1 + 3


def test_known_cells_are_those_of_any(spark):
    records = view(spark, SF, "tall").where("detector = 'a'")
    types = [t["type"] for t in records.select("type").distinct().collect()]
    rows = lambda df: sorted(tuple(x) for x in df.select("type", "sev", "cell_phase", "detector", F.round("auroc", 9), F.round("tpr", 9)).collect())
    assert rows(metrics.known_cell_metrics(records, types, (1, 2, 3), ("b", "a"))) == rows(metrics.cell_metrics(records))
    with pytest.raises(PySparkException):
        metrics.known_cell_metrics(records, types[1:], (1, 2, 3), ("a",)).collect()


def test_benchmark_names_all_its_cells():
    assert set(injected.LOCAL) == {"constvel", "laplacian", "vlap", "velocity"} and set(inject.SEVERITIES) == {1, 2, 3}
