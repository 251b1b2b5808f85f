"""Mesh topology and geometry on long tables: edges, neighbours, hops, volumes, gaps, surfaces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import draw, norm3

NORMAL, OBSTACLE, HANDLE = 0, 1, 3
VERTICES = ("v0", "v1", "v2", "v3")


def displacement(positions: DataFrame, nodes: DataFrame, on: Sequence[str] = ("node",)) -> DataFrame:
    """positions with ux, uy, uz: offset from the rest position."""
    joined = positions.join(nodes, list(on))
    return joined.select(*positions.columns, "node_type", *[(F.col(c) - F.col(f"r{c}")).alias(f"u{c}") for c in "xyz"])


def plate(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == NORMAL)


def actuator(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == OBSTACLE)


def one_hot(nodes: DataFrame, classes: int = 4) -> DataFrame:
    """nodes with type_0 .. type_3."""
    return nodes.withColumns({f"type_{k}": (F.col("node_type") == k).cast("double") for k in range(classes)})


def run_lengths(positions: DataFrame) -> DataFrame:
    """(sim, t_max): one more than the last frame of each run."""
    return positions.groupBy("sim").agg((F.max("frame") + 1).alias("t_max"))


def mesh_edges(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each undirected edge of the tets in both directions: keys, src, dst."""
    pairs = [F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for i, a in enumerate(VERTICES) for b in VERTICES[i + 1 :]]
    once = cells.select(*keys, F.explode(F.array(*pairs)).alias("e")).select(*keys, "e.a", "e.b").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return once.select(*keys, both.alias("e")).select(*keys, "e.src", "e.dst")


def neighbour_mean(values: DataFrame, edges: DataFrame, columns: Sequence[str], keys: Sequence[str], edge_keys: Sequence[str] = ()) -> DataFrame:
    """values (keys, node, columns) with mean_<column> over the neighbours; 0 for nodes without any. keys: what one mesh
    state is (say sim, frame); edge_keys: those of them that the edges have."""
    sent = values.select(*keys, F.col("node").alias("src"), *columns).join(edges, [*edge_keys, "src"])
    means = sent.groupBy(*keys, F.col("dst").alias("node")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return values.join(means, [*keys, "node"], "left").fillna(0.0, [f"mean_{c}" for c in columns])


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, own): the edges that lead to plate nodes, and each plate node's to itself (own)."""
    to = plate(nodes).select(F.col("node").alias("dst"))
    return edges.join(to, "dst").select("src", "dst", F.lit(False).alias("own")).unionByName(to.select(F.col("dst").alias("src"), "dst", F.lit(True).alias("own")))


def scatter_sum(edge_values: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sum of edge values by receiving node."""
    return edge_values.groupBy(*keys, F.col("dst").alias("node")).agg(*[F.sum(c).alias(c) for c in columns])


def hops(centres: DataFrame, edges: DataFrame, allowed: DataFrame, steps: int, keys: Sequence[str] = (), edge_keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, depth): nodes within `steps` edges of the centres (keys, node) through allowed nodes only."""
    reached = centres.select(*keys, "node", F.lit(0).alias("depth"))
    for depth in range(1, steps + 1):
        front = reached.where(F.col("depth") == depth - 1).select(*keys, F.col("node").alias("src"))
        new = front.join(edges, [*edge_keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct().join(allowed, [*edge_keys, "node"], "left_semi")
        reached = reached.unionByName(new.join(reached, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
    return reached


def tet_volumes(cells: DataFrame, positions: DataFrame, keys: Sequence[str], cell_keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cell, volume): signed volumes. One join of the exploded vertices and one aggregation, whatever the mesh."""
    corners = cells.select(*cell_keys, "cell", F.posexplode(F.array(*VERTICES)).alias("corner", "node"))
    at = corners.join(positions, [*cell_keys, "node"])
    picked = at.groupBy(*keys, "cell").agg(*[F.max(F.when(F.col("corner") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in "xyz"])
    d = {(c, i): F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz" for i in (1, 2, 3)}
    cross = {"x": d["y", 1] * d["z", 2] - d["z", 1] * d["y", 2], "y": d["z", 1] * d["x", 2] - d["x", 1] * d["z", 2], "z": d["x", 1] * d["y", 2] - d["y", 1] * d["x", 2]}
    return picked.select(*keys, "cell", ((cross["x"] * d["x", 3] + cross["y"] * d["y", 3] + cross["z"] * d["z", 3]) / 6).alias("volume"))


def apply_deltas(positions: DataFrame, deltas: DataFrame, on: Sequence[str] = ("sim", "frame", "node")) -> DataFrame:
    """Positions with those of the sparse delta rows in place."""
    changed = deltas.select(*on, *[F.col(c).alias(f"d{c}") for c in "xyz"])
    return positions.join(changed, list(on), "left").select(*on, *[F.coalesce(f"d{c}", c).alias(c) for c in "xyz"])


def deviation(clean: DataFrame, copy: DataFrame, on: Sequence[str] = ("sim", "frame", "node")) -> DataFrame:
    """(on, distance) of each node from its clean twin."""
    other = copy.select(*on, *[F.col(c).alias(f"c{c}") for c in "xyz"])
    return clean.join(other, list(on)).select(*on, norm3(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"), F.col("cz") - F.col("z")).alias("distance"))


def _near_pairs(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, a_node, ax, ay, az, b_node, bx, by, bz, distance) at most radius apart. A grid of twice the radius makes it an
    equi-join: each b is sent to the grid cells, eight as a rule, that the box about its ball reaches."""
    cell = lambda x: F.floor(x / (2 * radius))
    reach = lambda c: F.lit(radius * (1 + 1e-9)) + F.abs(c) * 1e-15
    own = a.select(*keys, F.col("node").alias("a_node"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(F.col(c)).alias(f"g{c}") for c in "xyz"])
    near = b.select(*keys, F.col("node").alias("b_node"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    for c in "xyz":
        at = F.col(f"b{c}")
        near = near.select("*", F.explode(F.sequence(cell(at - reach(at)), cell(at + reach(at)))).alias(f"g{c}"))
    d = norm3(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"), F.col("az") - F.col("bz"))
    return own.join(near, [*keys, "gx", "gy", "gz"]).drop("gx", "gy", "gz").withColumn("distance", d).where(F.col("distance") <= radius)


def within_radius(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, a_node, b_node, distance) at most radius apart."""
    return _near_pairs(a, b, radius, keys).select(*keys, "a_node", "b_node", "distance")


def _touching(positions: DataFrame, nodes: DataFrame, radius: float, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Pairs of an actuator node (a) and a plate node (b)."""
    typed = positions.join(nodes.select(*on, "node_type"), list(on))
    return _near_pairs(typed.where(F.col("node_type") == OBSTACLE), typed.where(F.col("node_type") == NORMAL), radius, keys)


def world_edges(positions: DataFrame, nodes: DataFrame, radius: float, keys: Sequence[str] = ("sim", "frame"), on: Sequence[str] = ("node",)) -> DataFrame:
    """Contact edges between actuator and plate nodes, both directions: keys, src, dst, distance."""
    both = F.array(*[F.struct(F.col(f"{s}_node").alias("src"), F.col(f"{t}_node").alias("dst")) for s, t in ("ab", "ba")])
    return _touching(positions, nodes, radius, keys, on).select(*keys, F.explode(both).alias("e"), "distance").select(*keys, "e.src", "e.dst", "distance")


def contact_pairs(nodes: DataFrame, radius: float, k: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, plate, actuator, distance): up to k nearest actuator nodes within radius of each plate node at rest."""
    at = nodes.select(*keys, "node", "node_type", *[F.col(f"r{c}").alias(c) for c in "xyz"])
    pairs = within_radius(at.where(F.col("node_type") == NORMAL), at.where(F.col("node_type") == OBSTACLE), radius, keys)
    rank = F.row_number().over(Window.partitionBy(*keys, "a_node").orderBy("distance", "b_node"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).select(*keys, F.col("a_node").alias("plate"), F.col("b_node").alias("actuator"), "distance")


BLOCKS = 4  # a side of the grid over a mesh state's faces, so 64 blocks at most whatever the mesh


def blocked(items: DataFrame, keys: Sequence[str], low: Sequence[Column], high: Sequence[Column], point: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """items with their block, by the centre of their boxes (low, high) in a grid over those of their mesh state (keys); and (keys,
    blocks): of each block its number, the box about its items' boxes and one point of one of them."""
    state = Window.partitionBy(*keys)
    boxes = items.select("*", *[x.alias(f"__low_{c}") for c, x in zip("xyz", low, strict=True)], *[x.alias(f"__high_{c}") for c, x in zip("xyz", high, strict=True)], F.struct(*[x.alias(c) for c, x in zip("xyz", point, strict=True)]).alias("__point"))
    boxes = boxes.withColumns({f"__mid_{c}": (F.col(f"__low_{c}") + F.col(f"__high_{c}")) / 2 for c in "xyz"})
    place = {}
    for c in "xyz":
        first, last = F.min(f"__mid_{c}").over(state), F.max(f"__mid_{c}").over(state)
        share = F.when(last > first, (F.col(f"__mid_{c}") - first) / (last - first)).otherwise(0.0)
        place[f"__at_{c}"] = F.least(F.floor(share * BLOCKS), F.lit(BLOCKS - 1)).cast("int")
    placed = boxes.withColumns(place).withColumn("block", (F.col("__at_x") * BLOCKS + F.col("__at_y")) * BLOCKS + F.col("__at_z"))
    edges = [f(f"__{n}_{c}").alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"]
    found = placed.groupBy(*keys, "block").agg(*edges, F.min("__point").alias("point"))
    whole = found.groupBy(*keys).agg(F.collect_list(F.struct("block", *[f"{n}_{c}" for n in ("low", "high") for c in "xyz"], "point")).alias("blocks"))
    return placed.select(*items.columns, "block"), whole


def _least(p: Sequence[Column], b: Column) -> Column:
    """How near to a point anything within a block can be."""
    off = [F.greatest(b[f"low_{c}"] - x, x - b[f"high_{c}"], F.lit(0.0)) for c, x in zip("xyz", p, strict=True)]
    return norm3(*off)


def _reached(p: Sequence[Column], b: Column) -> Column:
    """How far from a point the block's own point is."""
    return norm3(*[b["point"][c] - x for c, x in zip("xyz", p, strict=True)])


def near_blocks(points: DataFrame, blocks: DataFrame, keys: Sequence[str], p: Sequence[Column]) -> DataFrame:
    """points once for each block that can hold what is nearest to them: those no farther than the nearest of the blocks' own
    points. A point meets the blocks of its state (64 at most), not their items."""
    both = points.join(blocks, list(keys)).withColumn("__most", F.array_min(F.transform("blocks", lambda b: _reached(p, b))))
    fit = F.filter("blocks", lambda b: _least(p, b) <= F.col("__most") * (1 + 1e-9))
    return both.withColumn("block", F.explode(F.transform(fit, lambda b: b["block"]))).drop("blocks", "__most")


def min_gap(positions: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("sim", "frame"), on: Sequence[str] = ("node",)) -> DataFrame:
    """(keys, gap): smallest plate-actuator node distance of each mesh state. Actuator nodes lie in blocks; only those blocks are
    opened, for only those plate nodes, that can be nearer than the state's nearest block point."""
    typed = positions.join(nodes.select(*on, "node_type"), list(on))
    at = [F.col(c) for c in "xyz"]
    tools, blocks = blocked(typed.where(F.col("node_type") == OBSTACLE).select(*keys, *"xyz"), keys, at, at, at)
    plates = typed.where(F.col("node_type") == NORMAL).select(*keys, *[F.col(c).alias(f"p{c}") for c in "xyz"])
    p = [F.col(f"p{c}") for c in "xyz"]
    held = plates.join(blocks, list(keys))
    most = held.groupBy(*keys).agg(F.min(F.array_min(F.transform("blocks", lambda b: _reached(p, b)))).alias("__most"))
    fit = F.filter("blocks", lambda b: _least(p, b) <= F.col("__most") * (1 + 1e-9))
    open_ = held.join(most, list(keys)).withColumn("block", F.explode(F.transform(fit, lambda b: b["block"]))).drop("blocks", "__most")
    d = norm3(*[F.col(f"p{c}") - F.col(c) for c in "xyz"])
    return open_.join(tools, [*keys, "block"]).groupBy(*keys).agg(F.min(d).alias("gap"))


def contact_frames(gaps: DataFrame, touching: float = 2e-3) -> DataFrame:
    """(sim, frame): frames with a gap below `touching`; for a sim without any, its frame of least gap."""
    best = gaps.groupBy("sim").agg(F.min_by("frame", F.struct("gap", "frame")).alias("best"), F.min("gap").alias("least"))
    return gaps.join(best, "sim").where((F.col("gap") < touching) | ((F.col("least") >= touching) & (F.col("frame") == F.col("best")))).select("sim", "frame")


def surface_triangles(cells: DataFrame, nodes: DataFrame, kind: int = OBSTACLE, keys: Sequence[str] = ()) -> DataFrame:
    """Faces (keys, a, b, c sorted) that belong to exactly one tet whose corners are all of the kind."""
    faces = [F.array_sort(F.array(*[v for j, v in enumerate(VERTICES) if j != i])) for i in range(4)]
    corners = cells.select(*keys, "cell", F.explode(F.array(*VERTICES)).alias("node"), *VERTICES).join(nodes.select(*keys, "node", "node_type"), [*keys, "node"])
    own = corners.groupBy(*keys, "cell", *VERTICES).agg(F.min((F.col("node_type") == kind).cast("int")).alias("all")).where("all = 1")
    all_faces = own.select(*keys, F.explode(F.array(*faces)).alias("f"))
    return all_faces.groupBy(*keys, "f").count().where("count = 1").select(*keys, *[F.col("f")[i].alias(n) for i, n in enumerate("abc")])


def grid_cell(points: DataFrame, keys: Sequence[str], n: int = 3, size: float = 448.0) -> DataFrame:
    """(keys, row, col): cell of the n x n grid that holds the points' mean pixel, clipped to the image."""
    at = points.groupBy(*keys).agg(F.avg("px").alias("px"), F.avg("py").alias("py"))
    place = lambda c: F.least(F.greatest(F.floor(F.col(c) * n / size), F.lit(0)), F.lit(n - 1)).cast("int")
    return at.select(*keys, place("py").alias("row"), place("px").alias("col"))


def project(points: DataFrame, matrix: Sequence[Sequence[float]], size: float = 448.0) -> DataFrame:
    """points with px, py: homogeneous transform, perspective division, y downwards, image size."""
    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    w = row(matrix[3])
    return points.withColumns({"px": (row(matrix[0]) / w + 1) / 2 * size, "py": (1 - row(matrix[1]) / w) / 2 * size})


def closest_on_triangles(pairs: DataFrame, p: str, a: str, b: str, c: str) -> DataFrame:
    """pairs with column near (d, x, y, z): the closest point of the triangle a, b, c to p, and its distance: the nearest of the
    plane's foot, if it lies inside, and the three edges' closest points. A point's name stands before x, y and z in the
    names of its columns. Each step is a column of its own, so that no expression is evaluated or planned twice."""
    at = lambda n: [F.col(f"{n}{k}") for k in "xyz"]
    sub = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    tiny, q = F.lit(1e-30), at(p)
    edges = [(at(u), at(v)) for u, v in ((a, b), (b, c), (c, a))]
    n, foot = at("__normal_"), at("__foot_")

    def share(u: list, v: list) -> Column:
        along = sub(v, u)
        return F.least(F.greatest(dot(sub(q, u), along) / F.greatest(dot(along, along), tiny), F.lit(0.0)), F.lit(1.0))

    def option(point: list) -> Column:
        return F.struct(norm3(*sub(q, point)).alias("d"), *[x.alias(k) for x, k in zip(point, "xyz", strict=True)])

    steps = pairs.withColumns({f"__normal_{k}": x for k, x in zip("xyz", cross(sub(at(b), at(a)), sub(at(c), at(a))), strict=True)})
    steps = steps.withColumns({"__height": dot(sub(q, at(a)), n) / F.greatest(dot(n, n), tiny)} | {f"__share_{i}": share(u, v) for i, (u, v) in enumerate(edges)})
    steps = steps.withColumns({f"__foot_{k}": x - F.col("__height") * y for k, x, y in zip("xyz", q, n, strict=True)})
    inside = [dot(cross(sub(v, u), sub(foot, u)), n) >= 0 for u, v in edges]
    options = [option([x + F.col(f"__share_{i}") * y for x, y in zip(u, sub(v, u), strict=True)]) for i, (u, v) in enumerate(edges)]
    steps = steps.withColumn("near", F.least(*options)).withColumn("near", F.when(inside[0] & inside[1] & inside[2], F.least(option(foot), "near")).otherwise(F.col("near")))
    return steps.drop(*[c for c in steps.columns if c.startswith(("__normal_", "__foot_", "__share_")) or c == "__height"])


def cornered(shapes: DataFrame, names: Sequence[str], positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, names, <name>x, <name>y, <name>z): where the corners of shapes (names: nodes, the same in every mesh state) are in each
    state that has them all. One join of the exploded corners and one aggregation, whatever their number."""
    corners = shapes.select(*names, F.posexplode(F.array(*names)).alias("__corner", "node"))
    at = corners.join(positions.select(*keys, "node", "x", "y", "z"), "node")
    places = [F.max(F.when(F.col("__corner") == i, F.col(c))).alias(f"{n}{c}") for i, n in enumerate(names) for c in "xyz"]
    return at.groupBy(*keys, *names).agg(*places, F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(names)).drop("__n")


def signed_distance(positions: DataFrame, nodes: DataFrame, cells: DataFrame, on: Sequence[str] = ("node",), points: DataFrame | None = None, state: Sequence[str] = ("sim", "frame")) -> DataFrame:
    """(state, node, distance) of plate nodes to the actuator's surface, negative inside one of its tets. Surface and
    tets are found once. The triangles of a frame lie in blocks of a grid; a node is held against those of the blocks that can be
    nearer than the nearest block's own point, and against the tets of the blocks that it lies in. points: (state, node) of those
    to measure only. state: what one mesh state is."""
    state = list(state)
    typed = positions.join(nodes.select(*on, "node_type"), list(on))
    if points is not None:
        typed = typed.join(points, [*state, "node"], "left_semi")
    points = typed.where(F.col("node_type") == NORMAL).select(*state, "node", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    hull = surface_triangles(cells, nodes)
    at = lambda n: [F.col(f"{n}{c}") for c in "xyz"]
    box = lambda f, names: [f(*[F.col(f"{n}{c}") for n in names]) for c in "xyz"]
    faces, blocks = blocked(cornered(hull, "abc", positions, state), state, box(F.least, "abc"), box(F.greatest, "abc"), at("a"))
    pairs = near_blocks(points, blocks, state, at("p")).join(faces, [*state, "block"])
    distance = closest_on_triangles(pairs, "p", "a", "b", "c").select(*state, "node", "near.d").groupBy(*state, "node").agg(F.min("d").alias("d"))
    own = cells.select("cell", F.explode(F.array(*VERTICES)).alias("node"), *VERTICES).join(nodes.select("node", "node_type"), "node").groupBy("cell", *VERTICES).agg(F.min((F.col("node_type") == OBSTACLE).cast("int")).alias("all")).where("all = 1").drop("all")

    def volume(a: list, b: list, c: list, d: list):
        u, v, w = ([x - y for x, y in zip(q, a, strict=True)] for q in (b, c, d))
        return (u[1] * v[2] - u[2] * v[1]) * w[0] + (u[2] * v[0] - u[0] * v[2]) * w[1] + (u[0] * v[1] - u[1] * v[0]) * w[2]

    p, q = at("p"), [at(v) for v in VERTICES]
    whole = F.signum(volume(*q))
    parts = [F.signum(volume(*[p if j == i else x for j, x in enumerate(q)])) for i in range(4)]
    within = (whole != 0) & (parts[0] == whole) & (parts[1] == whole) & (parts[2] == whole) & (parts[3] == whole)
    tets, blocks = blocked(cornered(own, VERTICES, positions, state), state, box(F.least, VERTICES), box(F.greatest, VERTICES), at("v0"))
    holding = F.filter("blocks", lambda b: _least(p, b) == 0)
    open_ = points.join(blocks, state).withColumn("block", F.explode(F.transform(holding, lambda b: b["block"]))).drop("blocks")
    inside = open_.join(tets, [*state, "block"]).where(within).select(*state, "node").distinct().withColumn("in", F.lit(True))
    return distance.join(inside, [*state, "node"], "left").select(*state, "node", F.when(F.col("in"), -F.col("d")).otherwise(F.col("d")).alias("distance"))


def _offset(left: str, right: str, out: str) -> list[Column]:
    """Offset columns of two sides' points, and their length."""
    d = [F.col(f"{left}{c}") - F.col(f"{right}{c}") for c in "xyz"]
    return [*[x.alias(f"{out}{c}") for x, c in zip(d, "xyz", strict=True)], norm3(*d).alias(f"{out}_length")]


def step_edge_features(positions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sim, frame, src, dst, rest_x, rest_y, rest_z, rest_length, now_x, now_y, now_z, now_length) of the mesh edges."""
    at = positions.join(nodes, "node")
    side = lambda n, s: at.select("sim", "frame", F.col("node").alias(n), *[F.col(c).alias(f"{s}_{c}") for c in "xyz"], *[F.col(f"r{c}").alias(f"{s}_r{c}") for c in "xyz"])
    both = edges.join(side("src", "a"), "src").join(side("dst", "b"), ["sim", "frame", "dst"])
    return both.select("sim", "frame", "src", "dst", *_offset("a_r", "b_r", "rest_")[:3], _offset("a_r", "b_r", "rest")[3], *_offset("a_", "b_", "now_")[:3], _offset("a_", "b_", "now")[3])


def contact_edge_features(positions: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(sim, frame, src, dst, now_x, now_y, now_z, now_length) of the contact edges within radius, both directions."""
    both = F.array(*[F.struct(F.col(f"{s}_node").alias("src"), F.col(f"{t}_node").alias("dst"), *_offset(s, t, "now_")[:3], _offset(s, t, "now")[3]) for s, t in ("ab", "ba")])
    return _touching(positions, nodes, radius, ("sim", "frame"), ("node",)).select("sim", "frame", F.explode(both).alias("e")).select("sim", "frame", "e.*")


def load_features(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sim, frame, node, own_u*, mean_u*, r*, off_*, type_*): the actuator's own displacement (0 for other nodes), its mean
    displacement, the rest position, the offset from the actuator's rest centroid, and the node's type."""
    u = displacement(positions, nodes)
    mean = u.where(F.col("node_type") == OBSTACLE).groupBy("sim", "frame").agg(*[F.avg(f"u{c}").alias(f"mean_u{c}") for c in "xyz"])
    centre = actuator(nodes).agg(*[F.avg(f"r{c}").alias(f"c{c}") for c in "xyz"]).agg(F.first(F.struct("cx", "cy", "cz"))).scalar()
    fixed = one_hot(nodes).withColumn("centre", centre).select("node", "rx", "ry", "rz", *[(F.col(f"r{c}") - F.col(f"centre.c{c}")).alias(f"off_{c}") for c in "xyz"], *[f"type_{k}" for k in range(4)])
    own = [F.when(F.col("node_type") == OBSTACLE, F.col(f"u{c}")).otherwise(0.0).alias(f"own_u{c}") for c in "xyz"]
    return u.select("sim", "frame", "node", *own).join(mean, ["sim", "frame"]).join(fixed, "node")


def load_edge_features(positions: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sim, frame, src, dst, x, y, z, length) of contact pairs (plate, actuator): from the plate node's rest position to the
    actuator node, and mirrored with the sign turned."""
    rest = nodes.select(F.col("node").alias("plate"), *[F.col(f"r{c}").alias(f"p_{c}") for c in "xyz"])
    tool = positions.select("sim", "frame", F.col("node").alias("actuator"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    both = tool.join(pairs.select("plate", "actuator"), "actuator").join(rest, "plate")
    one = both.select("sim", "frame", F.col("actuator").alias("src"), F.col("plate").alias("dst"), *_offset("a_", "p_", "")[:3], _offset("a_", "p_", "")[3].alias("length"))
    return one.unionByName(one.select("sim", "frame", F.col("dst").alias("src"), F.col("src").alias("dst"), *[(-F.col(c)).alias(c) for c in "xyz"], "length"))


def rest_edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, x, y, z, length) of the mesh edges at rest."""
    side = lambda n, s: nodes.select(F.col("node").alias(n), *[F.col(f"r{c}").alias(f"{s}_{c}") for c in "xyz"])
    both = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return both.select("src", "dst", *_offset("a_", "b_", "")[:3], _offset("a_", "b_", "")[3].alias("length"))


def crop_box(pixels: DataFrame, keys: Sequence[str] = ("sim",), margin: float = 1.08, pad: float = 4.0) -> DataFrame:
    """(keys, left, top, side) of the square about the pixels' bounding box, widened by margin and pad."""
    box = pixels.groupBy(*keys).agg(F.min("px").alias("a"), F.max("px").alias("b"), F.min("py").alias("c"), F.max("py").alias("e"))
    half = F.greatest(F.col("b") - F.col("a"), F.col("e") - F.col("c")) / 2 * margin + pad
    return box.select(*keys, ((F.col("a") + F.col("b")) / 2 - half).alias("left"), ((F.col("c") + F.col("e")) / 2 - half).alias("top"), (2 * half).alias("side"))


def training_pairs(positions: DataFrame, nodes: DataFrame, sigma: float, seed: int, t_max: int) -> DataFrame:
    """(sim, frame, node, tx, ty, tz): next - 2 * now + previous for frames 1 to t_max - 1, with normal noise of deviation sigma,
    drawn from (seed, sim, frame, node), on a plate node's position now."""
    order = Window.partitionBy("sim", "node").orderBy("frame")

    def noise(c: str) -> Column:
        u, v = ((draw(F.lit(seed), F.col("sim"), F.col("frame"), F.col("node"), F.lit(c + k)) + 1) / float(1 << 32) for k in "uv")
        return F.when(F.col("node_type") == NORMAL, sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)).otherwise(0.0)

    typed = positions.join(nodes.select("node", "node_type"), "node")
    target = [(F.lead(c).over(order) - 2 * (F.col(c) + noise(c)) + F.lag(c).over(order)).alias(f"t{c}") for c in "xyz"]
    return typed.select("sim", "frame", "node", *target).where(F.col("tx").isNotNull() & (F.col("frame") >= 1) & (F.col("frame") < t_max))
