"""Whole runs are scored where they lie: no step of a copy moves its rows."""

import re

from trajscreen.operators import inject, mesh, runs
from trajscreen.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def test_a_copys_statistics_move_no_rows_of_runs(spark):
    p, r, c = (view(spark, SF, n) for n in ("positions", "rest", "cells"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    with runs.dealt_by_run(spark):
        copy = inject.inject_global(runs.dealt(p), r, "lag", 2).persist()
        plan = runs.run_statistics(copy, r, c, mesh.mesh_edges(c), (10, 60, 2))._jdf.queryExecution().executedPlan().toString()
        copy.unpersist()
    assert not re.findall(r"Exchange (?:hash|range)partitioning\(sim", plan)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
