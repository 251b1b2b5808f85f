import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import detect, inject, mesh
from trajscreen.plans.fixtures import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    return view(spark, SF, "positions").where("sim <= 2 and frame < 40").cache(), view(spark, SF, "rest"), view(spark, SF, "cells")


def test_pairs_differ_only_where_the_copy_does(spark, toy):
    p = toy[0]
    deltas = p.where("node = 2 and frame between 9 and 11").select("sim", "frame", "node", (F.col("x") + 1).alias("x"), "y", "z")
    pairs = {(r.sim, r.node, r.side): (r.x, r.y, r.z) for r in inject.counterfactual_pairs(p, mesh.apply_deltas(p, deltas), 10).collect()}
    clean = {(r.sim, r.node): (r.x, r.y, r.z) for r in p.where("frame = 10").collect()}
    assert len(pairs) == 2 * len(clean)
    for (sim, node), place in clean.items():
        assert pairs[sim, node, "A"] == place
        assert pairs[sim, node, "B"] == pytest.approx((place[0] + (node == 2), *place[1:]))


def test_picked_frames_are_spread(spark):
    sizes = {"onset": 1, "sustained": 9, "clean": 7}
    plan = spark.createDataFrame([(1, "a", 1, 3 * i + 100 * j, ph) for j, (ph, n) in enumerate(sizes.items()) for i in range(n)] + [(2, "a", 1, 5, "onset"), (2, "a", 1, 6, "sustained")], "sim int, type string, sev int, frame int, phase string")
    got = {}
    for r in inject.pick_frames(plan).collect():
        got.setdefault((r.sim, r.phase), []).append(r.frame)
    assert {k: len(v) for k, v in got.items()} == {(1, "onset"): 1, (1, "sustained"): 2, (1, "clean"): 3, (2, "onset"): 1, (2, "sustained"): 1}
    for phase, most in (("sustained", 2), ("clean", 3)):
        places = [(f % 100) // 3 for f in sorted(got[1, phase])]
        gaps = np.diff([*places, sizes[phase]])
        assert places[0] == 0 and len(places) == most and gaps.max() - gaps.min() <= 1


def test_diagnostics_equal_plain_loops(spark, toy):
    p, r, c = toy
    pixels = p.select("sim", "frame", "node", (F.col("node") * 50.0).alias("px"), (F.col("node") * 20.0).alias("py"))
    levels = p.select("sim").distinct().withColumn("level", F.lit(2.0))
    got = {(d.sim, d.frame): d for d in detect.diagnostics(p, r, c, pixels, levels, k=2).collect()}
    kind = {n.node: n.node_type for n in r.collect()}
    plate, tool = ([n for n in sorted(kind) if kind[n] == t] for t in (0, 1))
    at = {}
    for q in p.collect():
        at.setdefault((q.sim, q.frame), {})[q.node] = np.array([q.x, q.y, q.z])
    bad = {(b.sim, b.frame): b["count"] for b in detect.inverted_cells(p, r, c).groupBy("sim", "frame").count().collect()}
    assert set(got) == {k for k in at if k[1] >= 2}
    for (sim, f), d in got.items():
        now, one, two = (at[sim, f - i] for i in range(3))
        score = {n: np.linalg.norm(now[n] - (2 * one[n] - two[n])) for n in plate}
        speed = {n: np.linalg.norm(now[n] - one[n]) for n in plate}
        hot = sorted(plate, key=lambda n: (-score[n], n))[:2]
        assert d.ratio == pytest.approx(np.mean(sorted(score.values())[-5:]) / 2)
        assert d.n_high == sum(s > 5 * np.median(list(score.values())) for s in score.values())
        assert d.gap_mm == pytest.approx(1000 * min(np.linalg.norm(now[a] - now[b]) for a in hot for b in tool))
        assert d.speed_ratio == pytest.approx(np.mean([speed[n] for n in hot]) / np.median(list(speed.values())))
        assert d.n_inverted == bad.get((sim, f), 0)
