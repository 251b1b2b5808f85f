import numpy as np
import pytest

from trajscreen.operators import detect


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_causal_scores_of_uneven_tracks(spark, monkeypatch):
    """Arrays are scored in tasks of Python; before, each frame carried its node's whole track."""
    monkeypatch.setattr(detect, "TRACKS", 40)
    rng, rows = np.random.default_rng(1), []
    for node in range(12):
        frames = sorted(rng.choice(30, size=20 if node < 8 else 4 + node, replace=False).tolist()) if node % 3 else list(range(20))
        rows += [(3, f, node, float(v), 0.0, 0.0) for f, v in zip(frames, rng.normal(size=len(frames)).cumsum(), strict=True)]
    df = detect.velocity_causal_scores(spark.createDataFrame(rows, "sim int, frame int, node int, x double, y double, z double"))
    assert "MapInArrow" in plan_of(df)
    got = {(r.frame, r.node): r.score for r in df.collect()}
    want = {}
    for node in range(12):
        own = sorted((r[1], r[3]) for r in rows if r[2] == node)
        speed = [(f, abs(x - own[i][1])) for i, (f, x) in enumerate(own[1:])]
        for f, s in speed:
            past = [v for g, v in speed if g <= max(f - 4, 5)]
            if past:
                centre = np.median(past)
                want[f, node] = abs(s - centre) / (1.4826 * np.median(np.abs(np.array(past) - centre)) + 1e-9)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
