"""Hard negatives: packing and search against brute force, score windows, ties, odd rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajscreen.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=5, least=80, most=100):
    """rows [(id, label, vector)] of distinct ids -> the rows that mined() returns for anchors of id % 10 == 0."""
    sound = [(i, c, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, c, v in rows if None not in (i, c, v) and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in sound), default=0)
    sound = [(i, c, np.pad(v, (0, width - len(v)))) for i, c, v in sound]
    out = []
    for i, c, v in sound:
        if i % 10 == 0:
            scored = sorted((-int(v @ w), j, d) for j, d, w in sound if j != i)
            for p, j, _ in [x for x in scored if x[2] == c][:positives]:
                fit = [(s, k) for s, k, d in scored if d != c and least * -p <= 100 * -s <= most * -p][:negatives]
                out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def made(n, d, seed, labels=4, repeats=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, d))
    x = [(centres[r.integers(labels)] + r.normal(size=d) * 0.7).round(1).tolist() for _ in range(n)]
    if repeats:
        x = [x[i % 7] if i % 3 else x[i] for i in range(n)]
    return [(i, int(r.integers(labels)), v) for i, v in enumerate(x)]


def found(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(map(tuple, hn.mined(df, F.col("vec_id") % 10 == 0, **parameters).collect()))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 900), st.integers(1, 6), st.integers(1, 60), st.integers(0, 99))
def test_packing_keeps_rows_and_places_them_by_the_cuts(n, d, parts, seed):
    x = np.random.default_rng(seed).integers(-5, 6, size=(n, d))
    order, starts, tree = hn.cuts(x, parts)
    assert sorted(order.tolist()) == list(range(n)) and starts[0] == 0 and starts == sorted(set(starts))
    number = hn.placed(x, tree)
    assert number.min() >= 0 and number.max() < len(starts)


def test_tree_prunes_and_is_exact():
    r = np.random.default_rng(3)
    x = np.sort(r.integers(-200, 200, size=(4000, 2)), axis=0)
    tree = hn.Tree(np.arange(4000), [i % 3 for i in range(4000)], x, np.arange(0, 4000, 64))
    opened = []
    real = tree.values
    tree.values = type("Seen", (), {"__getitem__": lambda _, s: opened.append(s) or real[s], "__len__": lambda _: 4000})()
    q = np.array([3, -1])
    (got,) = tree.search(q, 5, 5 % 3, False, [(100.0, 300.0)], 4)
    scores = x @ q
    assert got == sorted([(int(s), i) for i, s in enumerate(scores) if i % 3 != 5 % 3 and 100 <= s <= 300], key=lambda y: (-y[0], y[1]))[:4]
    assert len(opened) < 40  # of 63 pages


@pytest.mark.parametrize("n, d, repeats", [(60, 3, False), (300, 8, True), (2600, 16, False)])
def test_equals_brute_force(spark, n, d, repeats):
    rows = made(n, d, n, repeats=repeats)
    assert found(spark, rows) == brute(rows)


def test_other_windows_and_numbers(spark):
    rows = made(200, 4, 1)
    assert found(spark, rows, positives=2, negatives=3, least=50, most=120) == brute(rows, 2, 3, 50, 120)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0, 2.0]), (10, None, [1.0, 2.0]), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [nan, 1.0]), (50, 2, [1.0, inf]), (60, 1, []), (61, 1, [0.5]), (62, 2, [0.4, 0.0]), (70, 3, [1.0, 1.0])]
    rows = made(80, 2, 5) + [(i if i is None else i + 1000, c, v) for i, c, v in odd]
    assert found(spark, rows + rows[:25]) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(10, 1, [1.0])]) == []
    extra = spark.createDataFrame([(0, "a", [1.0], 3, 1), (1, "a", [1.0], 3, 1), (2, "b", [0.9], 3, 1)], "`the.id` int, kind string, v array<float>, rank int, id int")
    assert [tuple(r) for r in hn.mined(extra, F.col("`the.id`") == 0, "the.id", "kind", "v").collect()] == [(0, 1, 1, 2, 65536, 58880)]
    with pytest.raises(ValueError):
        found(spark, [(10, 1, [1e9]), (11, 1, [1.0])])
