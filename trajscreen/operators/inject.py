"""Labelled corruption of runs: planning, whole-run errors, local patches as sparse deltas, labels, frame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import draw
from trajscreen.operators.mesh import NORMAL, OBSTACLE, closest_on_triangles, contact_frames, hops, surface_triangles

TYPES = ("hourglass", "penetration", "inversion", "instability", "frozen")
SEVERITIES = {1: 1.0, 2: 10.0, 3: 100.0}


def plan_copies(sims: DataFrame, types: Sequence[str] = TYPES, severities: Sequence[int] = (1, 2, 3), onset: tuple[int, int] = (40, 300)) -> DataFrame:
    """(sim, type, sev, seed, t0) for every sim, type and severity; the onset is drawn from the seed."""
    combos = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("i"), F.lit(s).alias("sev")) for i, t in enumerate(types) for s in severities])
    planned = sims.select("sim", F.explode(combos).alias("c")).select("sim", "c.type", "c.sev", (F.col("sim") * 100 + F.col("c.i") * 10 + F.col("c.sev")).alias("seed"))
    return planned.withColumn("t0", (onset[0] + F.pmod(draw(F.col("seed"), "t0"), F.lit(onset[1] - onset[0]))).cast("int"))


def inject_global(positions: DataFrame, nodes: DataFrame, kind: str, parameter: float) -> DataFrame:
    """Positions whose plate displacement is scaled by 1 + parameter, lags by parameter frames, or runs at parameter times
    the speed (interpolated, held at the last frame). Other nodes stay. Parameters 0, 0 and 1 change nothing."""
    rest = nodes.select("node", "node_type", "rx", "ry", "rz")
    at = positions.join(rest, "node")
    is_plate = F.col("node_type") == NORMAL
    if kind == "scale":
        return at.select("sim", "frame", "node", *[F.when(is_plate, F.col(f"r{c}") + (1 + parameter) * (F.col(c) - F.col(f"r{c}"))).otherwise(F.col(c)).alias(c) for c in "xyz"])
    last = F.max("frame").over(Window.partitionBy("sim", "node"))
    if kind == "lag":
        moved = at.withColumn("lo", F.greatest(F.col("frame") - int(parameter), F.lit(0))).withColumn("hi", F.col("lo")).withColumn("w", F.lit(0.0))
    elif kind == "timescale":
        t = F.col("frame") * F.lit(float(parameter))
        moved = at.withColumn("last", last).withColumn("lo", F.least(F.floor(t), F.col("last")).cast("int")).withColumn("w", t - F.floor(t)).withColumn("hi", F.least(F.col("lo") + 1, F.col("last")))
    else:
        raise ValueError(f"no whole-run error of kind {kind}")
    of = lambda n: positions.select("sim", "node", F.col("frame").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in "xyz"])
    joined = moved.join(of("lo"), ["sim", "node", "lo"]).join(of("hi"), ["sim", "node", "hi"])
    return joined.select("sim", "frame", "node", *[F.when(is_plate, F.col(f"r{c}") + ((1 - F.col("w")) * (F.col(f"lo_{c}") - F.col(f"r{c}")) + F.col("w") * (F.col(f"hi_{c}") - F.col(f"r{c}")))).otherwise(F.col(c)).alias(c) for c in "xyz"])


def inject_globals(positions: DataFrame, nodes: DataFrame, errors: Sequence[tuple[str, float]]) -> DataFrame:
    """(sim, copy, frame, node, x, y, z): every run under each (kind, parameter), as inject_global gives it; copy is its place among
    errors, kind clean the run as it is. All copies come by one window and one join, both by node of a run."""
    track = Window.partitionBy("sim", "node")
    after = lambda c: F.lead(c).over(track.orderBy("frame"))
    at = positions.join(nodes.select("node", "node_type", "rx", "ry", "rz"), "node")
    held = at.select("sim", "node", F.col("frame").alias("lo"), *[F.col(c).alias(f"lo_{c}") for c in "xyz"], after("frame").alias("then"), *[after(c).alias(f"hi_{c}") for c in "xyz"])

    def place(copy: int, kind: str, v: float):
        lo, hi, w = F.col("frame"), None, F.lit(0.0)
        if kind == "lag":
            lo = F.greatest(F.col("frame") - int(v), F.lit(0))
        elif kind == "timescale":
            t = F.col("frame") * F.lit(float(v))
            lo, w = F.least(F.floor(t), F.col("last")).cast("int"), t - F.floor(t)
            hi = F.least(lo + 1, F.col("last"))
        elif kind not in ("clean", "scale"):
            raise ValueError(f"no whole-run error of kind {kind}")
        return F.struct(F.lit(copy).alias("copy"), F.lit(kind == "clean").alias("same"), F.lit(1.0 + v if kind == "scale" else 1.0).alias("gain"), lo.cast("int").alias("lo"), (lo if hi is None else hi).cast("int").alias("hi"), w.alias("w"))

    spread = at.withColumn("last", F.max("frame").over(track)).select("sim", "frame", "node", "node_type", *"xyz", "rx", "ry", "rz", F.explode(F.array(*[place(i, k, v) for i, (k, v) in enumerate(errors)])).alias("e"))
    spread = spread.select("sim", "frame", "node", "node_type", *"xyz", "rx", "ry", "rz", "e.*")
    joined = spread.join(held, ["sim", "node", "lo"]).where((F.col("hi") == F.col("lo")) | (F.col("hi") == F.col("then")))

    def moved(c: str):
        rest, first = F.col(f"r{c}"), F.col(f"lo_{c}")
        second = F.when(F.col("hi") == F.col("lo"), first).otherwise(F.col(f"hi_{c}"))
        changed = (F.col("node_type") == NORMAL) & ~F.col("same")
        return F.when(changed, rest + F.col("gain") * ((1 - F.col("w")) * (first - rest) + F.col("w") * (second - rest))).otherwise(F.col(c)).alias(c)

    return joined.select("sim", "copy", "frame", "node", *[moved(c) for c in "xyz"])


def unit_draws(*parts) -> list:
    """Three numbers in (-1, 1) from a hash, not yet scaled to a direction."""
    return [(draw(*parts, axis) / F.lit(float(1 << 31)) - 1.0) for axis in "xyz"]


def patch(copies: DataFrame, centres: DataFrame, edges: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """(copy columns, node, depth): plate nodes within `steps` edges of each copy's centre (sim, type, sev, node)."""
    keys = ["sim", "type", "sev"]
    reached = hops(centres.select(*keys, "node"), edges, nodes.where(F.col("node_type") == NORMAL).select("node"), steps, keys)
    return copies.join(reached, keys)


def moving_centres(copies: DataFrame, positions: DataFrame, nodes: DataFrame, reach: int = 10) -> DataFrame:
    """(sim, type, sev, node): a plate node among the quarter that moves most between t0 - reach and t0 + reach."""
    keys = ["sim", "type", "sev"]
    own = positions.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node")
    at = lambda off, p: copies.select(*keys, "seed", (F.col("t0") + off).alias("frame")).join(own, ["sim", "frame"]).select(*keys, "seed", "node", *[F.col(c).alias(p + c) for c in "xyz"])
    both = at(-reach, "a").join(at(reach, "b"), [*keys, "seed", "node"])
    motion = both.withColumn("m", F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"), F.lit(0.0))))
    top = motion.withColumn("q", F.percentile("m", F.lit(0.75)).over(Window.partitionBy(*keys))).where("m >= q")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(F.col("seed"), "centre", F.col("node")), "node"))
    return top.withColumn("r", rank).where("r = 1").select(*keys, "node")


def _deltas(patched: DataFrame, frames, positions: DataFrame, offsets: list) -> DataFrame:
    spread = patched.withColumn("frame", F.explode(frames))
    joined = spread.join(positions, ["sim", "frame", "node"])
    return joined.select("sim", "type", "sev", "frame", "node", *[(F.col(c) + o).alias(c) for c, o in zip("xyz", offsets, strict=True)])


def inject_hourglass(patched: DataFrame, positions: DataFrame, steps: DataFrame, frames: int = 5) -> DataFrame:
    """Deltas: along one direction, up on even depths and down on odd ones, for some frames from t0 on."""
    d = unit_draws(F.col("seed"), "direction")
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    size = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("sev")) * F.col("step")
    sign = F.when(F.col("depth") % 2 == 0, 1.0).otherwise(-1.0)
    return _deltas(patched.join(steps, "sim"), F.sequence("t0", F.col("t0") + (frames - 1)), positions, [size * sign * x / length for x in d])


def inject_instability(patched: DataFrame, positions: DataFrame, steps: DataFrame, frames: int = 8, growth: float = 1.6) -> DataFrame:
    """Deltas: each node in a direction of its own, back and forth, growing to the full size."""
    d = unit_draws(F.col("seed"), "direction", F.col("node"))
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    size = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("sev")) * F.col("step")
    j = F.col("frame") - F.col("t0")
    swing = F.pow(F.lit(growth), (j - (frames - 1)).cast("double")) * F.when(j % 2 == 0, 1.0).otherwise(-1.0)
    return _deltas(patched.join(steps, "sim"), F.sequence("t0", F.col("t0") + (frames - 1)), positions, [size * swing * x / length for x in d])


def inject_frozen(patched: DataFrame, positions: DataFrame, lengths: dict[int, int] | None = None) -> DataFrame:
    """Deltas: the patch holds its position of frame t0 for the next k - 1 frames."""
    lengths = lengths or {1: 3, 2: 10, 3: 30}
    k = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("sev"))
    held = patched.withColumn("k", k).join(positions.withColumnRenamed("frame", "t0"), ["sim", "t0", "node"])
    spread = held.withColumn("frame", F.explode(F.sequence(F.col("t0") + 1, F.col("t0") + F.col("k") - 1)))
    return spread.join(positions.select("sim", "frame", "node"), ["sim", "frame", "node"], "left_semi").select("sim", "type", "sev", "frame", "node", "x", "y", "z")


def _ending(df: DataFrame, t_max: int | DataFrame) -> DataFrame:
    """df with t_max, one number or that of the run."""
    return df.join(t_max.select("sim", "t_max"), "sim") if isinstance(t_max, DataFrame) else df.withColumn("t_max", F.lit(t_max))


def label_frames(deviations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, frame): frames with a node that is not where it is in the clean run."""
    return deviations.where("distance > 0").select(*keys, "frame").distinct()


def choose_frames(events: DataFrame, window: int = 40, guard: int = 3, t_max: int | DataFrame = 350, keys: Sequence[str] = ("sim", "type", "sev"), least: int = 4) -> DataFrame:
    """(keys, frame, label, phase) from event frames (keys, frame): all of them, the first one the onset; and as many clean
    ones (at least `least`, as far as there are any) near the event but outside its guard band, by hash. t_max: the length of
    all runs, or (sim, t_max)."""
    ev = _ending(events, t_max).where((F.col("frame") >= 2) & (F.col("frame") < F.col("t_max")))
    bounds = ev.groupBy(*keys).agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count(F.lit(1)).alias("n"), F.first("t_max").alias("end"))
    marked = ev.join(bounds, list(keys)).select(*keys, "frame", F.lit(True).alias("label"), F.when(F.col("frame") == F.col("a"), "onset").otherwise("sustained").alias("phase"))
    near = bounds.withColumn("frame", F.explode(F.sequence(F.greatest(F.col("a") - window, F.lit(2)), F.least(F.col("b") + window, F.col("end") - 1))))
    free = near.where((F.col("frame") < F.greatest(F.col("a") - guard, F.lit(0))) | (F.col("frame") > F.col("b") + guard))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(*[F.col(k) for k in keys], "clean", F.col("frame")), "frame"))
    clean = free.withColumn("r", rank).where(F.col("r") <= F.greatest(F.lit(least), F.col("n"))).select(*keys, "frame", F.lit(False).alias("label"), F.lit("clean").alias("phase"))
    return marked.unionByName(clean)


def pick_frames(plan: DataFrame, keys: Sequence[str] = ("sim", "type", "sev"), sustained: int = 2, clean: int = 3) -> DataFrame:
    """The onset and up to so many evenly spaced sustained and clean frames of each copy."""
    window = Window.partitionBy(*keys, "phase")
    n, r = F.count(F.lit(1)).over(window), F.row_number().over(window.orderBy("frame")) - 1
    most = F.when(F.col("phase") == "sustained", sustained).when(F.col("phase") == "clean", clean).otherwise(1)
    spaced = plan.withColumn("n", n).withColumn("r", r).withColumn("m", F.least(F.col("n"), most))
    slot = F.floor(F.col("r") * F.col("m") / F.col("n"))
    first = F.ceil(slot * F.col("n") / F.col("m"))
    return spaced.where(F.col("r") == first).drop("n", "r", "m")


def contact_onsets(copies: DataFrame, gaps: DataFrame, onset: tuple[int, int] = (40, 300), touching: float = 2e-3) -> DataFrame:
    """copies with t0 at a frame of onset's range in which the actuator touches the plate, drawn from the seed; where it never
    does, at the frame of least gap. gaps: (sim, frame, gap)."""
    within = contact_frames(gaps.where((F.col("frame") >= onset[0]) & (F.col("frame") < onset[1])), touching).withColumnRenamed("frame", "contact")
    rank = F.row_number().over(Window.partitionBy("sim", "type", "sev").orderBy(draw(F.col("seed"), "contact", F.col("contact")), "contact"))
    drawn = copies.join(within, "sim").withColumn("r", rank).where("r = 1")
    return drawn.select(*[F.col("contact").cast("int").alias("t0") if c == "t0" else c for c in copies.columns])


def inject_penetration(copies: DataFrame, positions: DataFrame, nodes: DataFrame, cells: DataFrame, steps: DataFrame, frames: int = 5, most: int = 10, touching: float = 1e-3) -> DataFrame:
    """Deltas: the plate nodes nearest to the actuator at t0 (within `touching`, or the nearest one; `most` at most) are moved
    to the closest point of its surface and on by the size along that face's inward normal."""
    keys = ["sim", "type", "sev"]
    hull = surface_triangles(cells, nodes)
    corner = lambda n: positions.select("sim", "frame", F.col("node").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    plate = positions.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node").select("sim", "frame", "node", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    window = copies.join(steps, "sim").withColumn("frame", F.explode(F.sequence("t0", F.col("t0") + (frames - 1))))
    faces = window.select("sim", "frame").distinct().join(corner("a"), ["sim", "frame"]).join(hull, "a").join(corner("b"), ["sim", "frame", "b"]).join(corner("c"), ["sim", "frame", "c"])
    centre = positions.join(nodes.where(F.col("node_type") == OBSTACLE).select("node"), "node").groupBy("sim", "frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    faces = faces.join(centre, ["sim", "frame"])
    u, v = ([F.col(f"{n}{c}") - F.col(f"a{c}") for c in "xyz"] for n in "bc")
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    faces = faces.withColumns({f"n{c}": k for c, k in zip("xyz", normal, strict=True)})
    own = [F.col(f"n{c}") for c in "xyz"]
    outward = F.signum(sum(((F.col(f"a{c}") - F.col(f"m{c}")) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0)))
    length = F.greatest(F.sqrt(own[0] * own[0] + own[1] * own[1] + own[2] * own[2]), F.lit(1e-30))
    faces = faces.withColumn("turned", -outward / length)
    pairs = closest_on_triangles(plate.join(faces, ["sim", "frame"]), "p", "a", "b", "c")
    inward = [(F.col("turned") * F.col(f"n{c}")).alias(f"i{c}") for c in "xyz"]
    near = pairs.groupBy("sim", "frame", "node").agg(F.min(F.struct("near.d", *[F.col(f"near.{c}").alias(f"f{c}") for c in "xyz"], *inward)).alias("m"))
    near = near.select("sim", "frame", "node", "m.*")
    rank = Window.partitionBy(*keys).orderBy("d", "node")
    chosen = copies.join(near.withColumnRenamed("frame", "t0"), ["sim", "t0"]).withColumn("r", F.row_number().over(rank)).withColumn("least", F.min("d").over(Window.partitionBy(*keys)))
    chosen = chosen.where((F.col("r") <= most) & (F.col("d") <= F.greatest(F.lit(touching), F.col("least")))).select(*keys, "node")
    size = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("sev")) * F.col("step")
    moved = window.join(chosen, keys).join(near, ["sim", "frame", "node"])
    return moved.select(*keys, "frame", "node", *[(F.col(f"f{c}") + size * F.col(f"i{c}")).alias(c) for c in "xyz"])


def inject_inversion(copies: DataFrame, centres: DataFrame, positions: DataFrame, nodes: DataFrame, cells: DataFrame, frames: int = 5, shares: dict[int, float] | None = None) -> DataFrame:
    """Deltas: the centre node is reflected through the opposite face of a drawn plate tet that has it as a corner, by twice a
    share of its distance."""
    shares = shares or {1: 0.3, 2: 0.6, 3: 1.5}
    keys = ["sim", "type", "sev"]
    corners = cells.select("cell", F.explode(F.array("v0", "v1", "v2", "v3")).alias("node"), F.array("v0", "v1", "v2", "v3").alias("vs")).join(nodes.select("node", "node_type"), "node")
    own = corners.groupBy("cell", "vs").agg(F.max(F.abs(F.col("node_type") - NORMAL)).alias("off")).where("off = 0").select("cell", "vs", F.explode("vs").alias("node"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(F.col("seed"), "cell", F.col("cell")), "cell"))
    tet = copies.join(centres, keys).join(own, "node").withColumn("r", rank).where("r = 1").drop("r")
    turned = tet.withColumn("top", F.col("node")).withColumn("face", F.filter("vs", lambda v: v != F.col("top")))
    spread = turned.select(*keys, "top", *[F.get("face", F.lit(j)).alias(f"q{j}") for j in range(3)], F.explode(F.sequence("t0", F.col("t0") + (frames - 1))).alias("frame"))
    for name in ("top", "q0", "q1", "q2"):
        spread = spread.join(positions.select("sim", "frame", F.col("node").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"]), ["sim", "frame", name])
    u = [F.col(f"q1{c}") - F.col(f"q0{c}") for c in "xyz"]
    v = [F.col(f"q2{c}") - F.col(f"q0{c}") for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    nn = n[0] * n[0] + n[1] * n[1] + n[2] * n[2]
    height = sum(((F.col(f"top{c}") - F.col(f"q0{c}")) * k for c, k in zip("xyz", n, strict=True)), F.lit(0.0)) / nn
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("sev"))
    return spread.select(*keys, "frame", F.col("top").alias("node"), *[(F.col(f"top{c}") - 2 * share * height * k).alias(c) for c, k in zip("xyz", n, strict=True)])


def acceleration_floor(positions: DataFrame, nodes: DataFrame, t_max: int | DataFrame, first: int = 10) -> DataFrame:
    """(sim, floor): median over frames from `first` on of the plate's root mean square second difference."""
    order = Window.partitionBy("sim", "node").orderBy("frame")
    second = [(F.col(c) - 2 * F.lag(c, 1).over(order) + F.lag(c, 2).over(order)) for c in "xyz"]
    own = _ending(positions, t_max).join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node").where(F.col("frame") < F.col("t_max"))
    sq = own.select("sim", "frame", (second[0] * second[0] + second[1] * second[1] + second[2] * second[2]).alias("q")).where("q is not null")
    frames = sq.where(F.col("frame") >= first).groupBy("sim", "frame").agg(F.sqrt(F.avg("q")).alias("a"))
    return frames.groupBy("sim").agg(F.greatest(F.percentile("a", F.lit(0.5)), F.lit(1e-9)).alias("floor"))


def plan_blowups(sims: DataFrame, floors: DataFrame, steps: DataFrame, t_max: int | DataFrame = 350, growth: float = 1.3, cap: float = 100.0, hold: int = 5, onset: int = 40) -> DataFrame:
    """(sim, kind, seed, start, n_grow, t0, top): a blow-up from the run's acceleration floor to cap times its step, at a
    growing rate, held for some frames; the onset is drawn so that it ends within the run."""
    top = F.col("step") * cap
    both = _ending(sims.select("sim"), t_max).join(floors, "sim").join(steps, "sim").withColumn("top", top)
    n = F.least(F.ceil(F.log(F.col("top") / F.col("floor")) / F.log(F.lit(growth))) + 1, F.col("t_max") - 50).cast("int")
    grown = both.withColumn("n_grow", F.greatest(n, F.lit(1))).withColumn("start", F.col("top") / F.pow(F.lit(growth), (F.col("n_grow") - 1).cast("double")))
    room = F.greatest(F.col("t_max") - (hold + onset) - F.col("n_grow"), F.lit(1))
    return grown.select("sim", F.lit("blowup").alias("type"), F.lit(3).alias("sev"), (F.col("sim") * 100 + 99).alias("seed"), "start", "n_grow", "top", (onset + F.pmod(draw(F.col("sim") * 100 + 99, "t0"), room)).cast("int").alias("t0"))


def inject_blowup(patched: DataFrame, positions: DataFrame, growth: float = 1.3, hold: int = 5) -> DataFrame:
    """Deltas of planned blow-ups (plan_blowups joined with a patch): back and forth along each node's own direction."""
    d = unit_draws(F.col("seed"), "direction", F.col("node"))
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    j = F.col("frame") - F.col("t0")
    size = F.least(F.col("start") * F.pow(F.lit(growth), j.cast("double")), F.col("top")) * F.when(j % 2 == 0, 1.0).otherwise(-1.0)
    return _deltas(patched, F.sequence("t0", F.col("t0") + F.col("n_grow") + (hold - 1)), positions, [size * x / length for x in d])


def counterfactual_pairs(clean: DataFrame, corrupted: DataFrame, frame: int, keys: tuple[str, ...] = ("sim",)) -> DataFrame:
    """Rows of one frame, side A from the clean run and side B from the corrupted one."""
    pick = lambda df, side: df.where(F.col("frame") == frame).select(*keys, "frame", "node", "x", "y", "z").withColumn("side", F.lit(side))
    return pick(clean, "A").unionByName(pick(corrupted, "B"))
