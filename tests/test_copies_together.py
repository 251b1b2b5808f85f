"""Copies of the whole-run errors are made and scored together, as each would be alone."""

import pytest
from pyspark.sql import functions as F

from trajscreen.functions.lineage import cut
from trajscreen.operators import alarms, detect, inject, mesh, runs
from trajscreen.plans.fixtures import view

SF = "/root/testdata/sf0.001"
ERRORS = [("clean", 0.0), ("scale", 0.1), ("lag", 2.0), ("timescale", 0.8)]
FRAMES = (10, 2**31 - 1, 2)


@pytest.fixture(scope="module")
def case(spark):
    p, r, c = (view(spark, SF, n) for n in ("positions", "rest", "cells"))
    return cut(p), r, c


def test_copies_made_together_are_those_made_alone(case):
    p, r, _ = case
    made = inject.inject_globals(p, r, ERRORS)
    for i, (kind, v) in enumerate(ERRORS):
        alone = p if kind == "clean" else inject.inject_global(p, r, kind, v)
        rows = lambda df: sorted(tuple(x) for x in df.select("sim", "frame", "node", *[F.round(k, 9) for k in "xyz"]).collect())
        assert rows(made.where(F.col("copy") == i)) == rows(alone)


def test_unknown_errors_are_refused(case):
    p, r, _ = case
    with pytest.raises(ValueError):
        inject.inject_globals(p, r, [("twist", 1.0)])


def test_the_number_of_jobs_does_not_grow_with_the_grid(case, monkeypatch):
    p, r, c = case
    made, once = [], runs.cut
    monkeypatch.setattr(runs, "cut", lambda df: made.append(df) or once(df))
    found = runs.score_runs(p, r, c, mesh.mesh_edges(c), FRAMES, {"scale": (0.1,), "lag": (2,), "timescale": (0.8,)}, rows=p.count())
    assert len(made) == 3  # the deal, the rules, the contact; ten copies take no more
    got = {(x.sim, x.kind, x.detector): x.value for x in found.collect()}
    assert len(got) == 6 * 4 * p.select("sim").distinct().count()
    copy, edges = cut(inject.inject_global(p, r, "timescale", 0.8)), mesh.mesh_edges(c)
    kinds = {"constvel": detect.constvel_scores(copy), "laplacian": detect.laplacian_scores(copy, r, edges), "vlap": detect.velocity_laplacian_scores(copy, edges), "velocity": detect.velocity_scores(copy)}
    for name, scores in kinds.items():  # the statistics by the detectors themselves, one at a time
        tops = detect.frame_scores(detect.stride(scores, *FRAMES), r).withColumn("detector", F.lit(name))
        for x in alarms.run_stats(tops, detect.step_scale(copy, r)).collect():
            assert got[x.sim, "timescale", name] == pytest.approx(x.value, rel=1e-9)


def test_large_tables_hold_one_copy_at_a_time(case, monkeypatch):
    p, r, c = case
    monkeypatch.setattr(runs, "TOGETHER", 2 * p.count())
    sizes, make = [], inject.inject_globals
    monkeypatch.setattr(inject, "inject_globals", lambda p, r, errors: sizes.append(len(errors)) or make(p, r, errors))
    found = runs.score_runs(p, r, c, mesh.mesh_edges(c), FRAMES, {"scale": (0.1, 0.2)}, rows=p.count())
    assert sizes == [2, 1] and {(x.kind, x.parameter) for x in found.select("kind", "parameter").distinct().collect()} == {("clean", 0.0), ("scale", 0.1), ("scale", 0.2)}
