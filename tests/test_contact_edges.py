import numpy as np
import pytest

from trajscreen.operators import mesh


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_contact_pairs_are_joined_once_and_none_is_lost(spark, scale):
    rng = np.random.default_rng(0)
    at = [(1, f, n, *(scale * rng.integers(-6, 7, 3) / 2).tolist()) for f in (0, 1) for n in range(40)]
    nodes = spark.createDataFrame([(n, n % 2) for n in range(40)], "node int, node_type int")
    df = mesh.contact_edge_features(spark.createDataFrame(at, "sim int, frame int, node int, x double, y double, z double"), nodes, 2 * scale)
    assert plan_of(df).count("SortMergeJoin") + plan_of(df).count("BroadcastHashJoin") <= 3
    got = {(r.frame, r.src, r.dst): (r.now_x, r.now_length) for r in df.collect()}
    want = {}
    for a in at:
        for b in at:
            d = np.subtract(a[3:], b[3:])
            if a[1] == b[1] and a[2] % 2 != b[2] % 2 and np.sqrt((d * d).sum()) <= 2 * scale:
                want[a[1], a[2], b[2]] = (d[0], np.sqrt((d * d).sum()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
