"""Contact distances by blocks of a grid against brute force on random meshes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import mesh


def closest(p, a, b, c):
    """Distance from p to triangle a, b, c, by its Voronoi regions."""
    ab, ac, ap = b - a, c - a, p - a
    d1, d2 = ab @ ap, ac @ ap
    if d1 <= 0 and d2 <= 0:
        return np.linalg.norm(ap)
    bp = p - b
    d3, d4 = ab @ bp, ac @ bp
    if d3 >= 0 and d4 <= d3:
        return np.linalg.norm(bp)
    cp = p - c
    d5, d6 = ab @ cp, ac @ cp
    if d6 >= 0 and d5 <= d6:
        return np.linalg.norm(cp)
    vc = d1 * d4 - d3 * d2
    if vc <= 0 and d1 >= 0 and d3 <= 0:
        return np.linalg.norm(ap - ab * d1 / (d1 - d3))
    vb = d5 * d2 - d1 * d6
    if vb <= 0 and d2 >= 0 and d6 <= 0:
        return np.linalg.norm(ap - ac * d2 / (d2 - d6))
    va = d3 * d6 - d5 * d4
    if va <= 0 and d4 - d3 >= 0 and d5 - d6 >= 0:
        return np.linalg.norm(bp - (c - b) * (d4 - d3) / ((d4 - d3) + (d5 - d6)))
    v, w = vb / (va + vb + vc), vc / (va + vb + vc)
    return np.linalg.norm(ap - ab * v - ac * w)


def lattice(n):
    """Nodes of an n x n x n lattice and the tets of its cubes."""
    at = {(i, j, k): (i * n + j) * n + k for i in range(n) for j in range(n) for k in range(n)}
    tets = []
    for i in range(n - 1):
        for j in range(n - 1):
            for k in range(n - 1):
                v = [at[i + a, j + b, k + c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
                tets += [(v[0], v[1], v[3], v[7]), (v[0], v[1], v[5], v[7]), (v[0], v[2], v[3], v[7]), (v[0], v[2], v[6], v[7]), (v[0], v[4], v[5], v[7]), (v[0], v[4], v[6], v[7])]
    return np.array(list(at), float), tets


@pytest.fixture(scope="module", params=[2, 4])
def scene(spark, request):
    """An actuator lattice, bent anew in each of three frames, and plate nodes around and in it."""
    r = np.random.default_rng(request.param)
    rest, tets = lattice(request.param)
    n, m = len(rest), 25
    frames = []
    for f in range(3):
        tool = rest + r.normal(size=rest.shape) * 0.12 + f
        plate = np.concatenate([r.uniform(-1.5, request.param + 1.5, size=(m - 8, 3)), r.uniform(0, request.param - 1, size=(8, 3))]) + f
        frames.append(np.concatenate([tool, plate]))
    frames[2][n:] += 40  # far away
    nodes = spark.createDataFrame([(i, mesh.OBSTACLE if i < n else mesh.NORMAL, 0.0, 0.0, 0.0) for i in range(n + m)], "node int, node_type int, rx double, ry double, rz double")
    cells = spark.createDataFrame([(i, *t) for i, t in enumerate(tets)], "cell int, v0 int, v1 int, v2 int, v3 int")
    positions = spark.createDataFrame([(s, f, i, *map(float, x + s)) for s in (0, 7) for f, at in enumerate(frames) for i, x in enumerate(at)], "sim long, frame int, node int, x double, y double, z double").cache()
    return positions, nodes, cells, frames, tets, n, m


def test_signed_distance_equals_brute_force(scene):
    positions, nodes, cells, frames, tets, n, m = scene
    count = {}
    for t in tets:
        for i in range(4):
            face = tuple(sorted(t[:i] + t[i + 1 :]))
            count[face] = count.get(face, 0) + 1
    hull = [f for f, c in count.items() if c == 1]
    got = {(r["sim"], r["frame"], r["node"]): r["distance"] for r in mesh.signed_distance(positions, nodes, cells).collect()}
    assert len(got) == 2 * 3 * m
    signs = set()
    for f, at in enumerate(frames):
        for i in range(n, n + m):
            d = min(closest(at[i], *at[list(face)]) for face in hull)
            inside = False
            for t in tets:
                q = at[list(t)]
                share = np.linalg.solve((q[1:] - q[0]).T, at[i] - q[0])
                inside |= bool((share > 0).all() and share.sum() < 1)
            signs.add(inside)
            for sim in (0, 7):
                assert got[sim, f, i] == pytest.approx(-d if inside else d, abs=1e-9)
    assert signs == {True, False}


def test_min_gap_equals_brute_force(scene):
    positions, nodes, _, frames, _, n, _ = scene
    got = {(r["sim"], r["frame"]): r["gap"] for r in mesh.min_gap(positions, nodes).collect()}
    for f, at in enumerate(frames):
        want = np.linalg.norm(at[n:, None] - at[None, :n], axis=2).min()
        assert got[0, f] == pytest.approx(want) and got[7, f] == pytest.approx(want)


def test_few_faces_are_opened(scene):
    positions, nodes, cells, frames, tets, n, m = scene
    if n < 60:
        pytest.skip("too few faces to leave any out")
    state = ["sim", "frame"]
    at = [F.col(c) for c in "xyz"]
    typed = positions.join(nodes.select("node", "node_type"), "node")
    tools, blocks = mesh.blocked(typed.where("node_type = 1").select(*state, *"xyz"), state, at, at, at)
    points = typed.where("node_type = 0").select(*state, "node", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    opened = mesh.near_blocks(points, blocks, state, [F.col(f"p{c}") for c in "xyz"]).join(tools, [*state, "block"]).count()
    assert opened < 0.4 * 2 * 3 * m * n
