"""Detectors over long position tables (sim, frame, node, x, y, z) and their calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import median, norm3
from trajscreen.functions.lineage import kept
from trajscreen.functions.workers import carried
from trajscreen.operators.metrics import quantile
from trajscreen.operators.mesh import NORMAL, OBSTACLE, displacement, linked, neighbour_mean, signed_distance, tet_volumes

carried(__name__)

KEYS = ("sim", "frame", "node")
MAD = 1.4826
TRACKS = 1 << 19  # speeds that are sorted at once


def track():
    """A node's frames in order."""
    return Window.partitionBy("sim", "node").orderBy("frame")


def _lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(track())


def constvel_scores(positions: DataFrame) -> DataFrame:
    """Distance from where the last two frames point to, from the third frame on."""
    d = [F.col(c) - (2 * _lag(c, 1) - _lag(c, 2)) for c in "xyz"]
    return positions.select(*KEYS, norm3(*d).alias("score")).where(F.col("score").isNotNull())


def residual_scores(positions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Distance from an outside one-step prediction: predictions (sim, frame, node, ax, ay, az) are accelerations."""
    ahead = positions.select(*KEYS, *[(F.col(c) - (2 * _lag(c, 1) - _lag(c, 2))).alias(f"d{c}") for c in "xyz"]).where(F.col("dx").isNotNull())
    return ahead.join(predictions, list(KEYS)).select(*KEYS, norm3(*[F.col(f"d{c}") - F.col(f"a{c}") for c in "xyz"]).alias("score"))


def speeds(positions: DataFrame) -> DataFrame:
    """(sim, frame, node, speed) from the second frame on."""
    return positions.select(*KEYS, norm3(*[F.col(c) - _lag(c, 1) for c in "xyz"]).alias("speed")).where(F.col("speed").isNotNull())


def velocity_scores(positions: DataFrame) -> DataFrame:
    """Deviation of a node's speed from its median over the run, in scaled MADs."""
    node = Window.partitionBy("sim", "node")
    centred = speeds(positions).withColumn("dev", F.abs(F.col("speed") - median(F.col("speed")).over(node)))
    return centred.select(*KEYS, (F.col("dev") / (MAD * median(F.col("dev")).over(node) + 1e-9)).alias("score"))


def _middle(ordered: np.ndarray) -> np.ndarray:
    """Medians of sorted rows, as a column."""
    n = ordered.shape[1]
    return (ordered[:, (n - 1) // 2, None] + ordered[:, n // 2, None]) / 2


def _against_past(min_past: int):
    """Rows (sim, node, frames, speeds), frames rising -> (sim, node, frame, score). Tracks of the same frames are scored together: each
    past is sorted once for all frames that look back on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, frames, speed = batch.column("frames").offsets.to_numpy(), *(batch.column(c).values.to_numpy() for c in ("frames", "speeds"))
            alike: dict[bytes, list[int]] = {}
            for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                alike.setdefault(frames[lo:hi].tobytes(), []).append(i)
            for key, rows in alike.items():
                own = np.frombuffer(key, frames.dtype)
                seen = np.searchsorted(own, np.maximum(own - 4, min_past), "right")
                if not (scored := np.flatnonzero(seen > 0)).size:
                    continue
                step = max(1, TRACKS // len(own))
                for some in (np.array(rows[at : at + step]) for at in range(0, len(rows), step)):
                    v = speed[bounds[some][:, None] + np.arange(len(own))]
                    score = np.empty(v.shape)
                    for n in np.unique(seen[scored]).tolist():
                        past = np.sort(v[:, :n], axis=1)
                        centre = _middle(past)
                        spread = MAD * _middle(np.sort(np.abs(past - centre), axis=1)) + 1e-9
                        at = np.flatnonzero(seen == n)
                        score[:, at] = np.abs(v[:, at] - centre) / spread
                    of = pa.array(np.repeat(some, len(scored)))
                    yield pa.RecordBatch.from_arrays([batch.column("sim").take(of), pa.array(np.tile(own[scored], len(some))), batch.column("node").take(of), pa.array(score[:, scored].reshape(-1))], [*KEYS, "score"])

    return run


def velocity_causal_scores(positions: DataFrame, min_past: int = 5) -> DataFrame:
    """As velocity_scores, by medians over frames up to max(t - 4, min_past) only. A node's speeds come together in one
    array (as long as its run) by one shuffle by (sim, node), and arrays are scored in numpy."""
    track = F.array_sort(F.collect_list(F.struct("frame", "speed")))
    tracks = speeds(positions).groupBy("sim", "node").agg(track.alias("track")).select("sim", "node", F.col("track.frame").alias("frames"), F.col("track.speed").alias("speeds"))
    kinds = {f.name: f.dataType.simpleString() for f in positions.schema.fields}
    return tracks.mapInArrow(_against_past(min_past), "".join(f"{c} {kinds[c]}, " for c in KEYS) + "score double")


def _off_neighbours(values: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = neighbour_mean(values, edges, columns, ("sim", "frame"), [c for c in edges.columns if c == "sim"])
    return means.select(*KEYS, norm3(*[F.col(c) - F.col(f"mean_{c}") for c in columns]).alias("score"))


def laplacian_scores(positions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance of a node's displacement from its neighbours' mean displacement."""
    return _off_neighbours(displacement(positions, nodes).drop("node_type"), edges, ("ux", "uy", "uz"))


def velocity_laplacian_scores(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for velocities, from the second frame on."""
    v = positions.select(*KEYS, *[(F.col(c) - _lag(c, 1)).alias(f"v{c}") for c in "xyz"]).where(F.col("vx").isNotNull())
    return _off_neighbours(v, edges, ("vx", "vy", "vz"))


def inverted_cells(positions: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(sim, frame, cell) of tets whose volume's sign is not that at rest; volume 0 counts where the rest has a sign."""
    rest = nodes.select(F.lit(0).alias("at"), "node", *[F.col(f"r{c}").alias(c) for c in "xyz"])
    reference = tet_volumes(cells, rest, ("at",)).select("cell", F.signum("volume").alias("rest_sign"))
    return tet_volumes(cells, positions, ("sim", "frame")).join(reference, "cell").where(F.signum("volume") != F.col("rest_sign")).select("sim", "frame", "cell")


def jacobian_scores(positions: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Number of inverted tets at each node."""
    bad = inverted_cells(positions, nodes, cells).join(cells, "cell").select("sim", "frame", F.explode(F.array("v0", "v1", "v2", "v3")).alias("node"))
    counts = bad.groupBy("sim", "frame", "node").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return positions.select(*KEYS).join(counts, list(KEYS), "left").select(*KEYS, F.coalesce("n", F.lit(0.0)).alias("score"))


def frame_scores(scores: DataFrame, nodes: DataFrame, k: int = 5, keys: Sequence[str] = ("sim", "frame")) -> DataFrame:
    """(keys, score): mean of the k largest scores of plate nodes."""
    own = scores.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "node"))
    return own.withColumn("r", rank).where(F.col("r") <= k).groupBy(*keys).agg(F.avg("score").alias("score"))


def jacobian_frame_scores(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inverted plate tets, each counted at its four nodes."""
    own = scores.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node")
    return own.groupBy("sim", "frame").agg((F.sum("score") / 4).alias("score"))


def _on(frames: Sequence[int]) -> Column:
    """Whether a row's frame is one of frames; a range is not listed."""
    if isinstance(frames, range):
        return (F.col("frame") >= frames.start) & (F.col("frame") < frames.stop) & ((F.col("frame") - frames.start) % frames.step == 0)
    return F.col("frame").isin(list(frames))


def calibrated(raw: DataFrame, nodes: DataFrame, frames: Sequence[int]) -> DataFrame:
    """raw (sim, frame, node, score) over its node's level: the node's median on the calibration frames plus the plate's
    median of those."""
    level = raw.where(_on(frames)).groupBy("sim", "node").agg(median(F.col("score")).alias("c"))
    plate = level.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node").groupBy("sim").agg(median(F.col("c")).alias("plate"))
    return raw.join(level, ["sim", "node"]).join(plate, "sim").select(*KEYS, (F.col("score") / (F.col("c") + F.col("plate") + 1e-12)).alias("score"))


def calibrated_causal(raw: DataFrame, nodes: DataFrame, frames: Sequence[int], gap: int = 3, least: int = 3) -> DataFrame:
    """The same from calibration frames before t - gap only, or the first `least` where there are fewer. The medians of
    each prefix of calibration frames are made once a node and joined by the prefix's length."""
    order = Window.partitionBy("sim", "node").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(Window.partitionBy("sim", "node").orderBy("frame"))
    level = raw.where(_on(frames)).select("sim", "node", number.alias("n"), median(F.col("score")).over(order).alias("c"))
    plate = level.join(nodes.where(F.col("node_type") == NORMAL).select("node"), "node").groupBy("sim", "n").agg(median(F.col("c")).alias("plate"))
    if isinstance(frames, range):
        past = F.greatest(F.ceil((F.least(F.col("frame") - gap, F.lit(frames.stop)) - frames.start) / frames.step).cast("int"), F.lit(0))
    else:
        past = sum(((F.col("frame") - gap) > f).cast("int") for f in frames)
    return raw.withColumn("n", F.greatest(past, F.lit(least))).join(level, ["sim", "node", "n"]).join(plate, ["sim", "n"]).select(*KEYS, (F.col("score") / (F.col("c") + F.col("plate") + 1e-12)).alias("score"))


def step_scale(positions: DataFrame, nodes: DataFrame, kind: int = NORMAL, before: int | None = None, floor: float = 0.0) -> DataFrame:
    """(sim, step): root mean square step of the nodes of a kind over the frames before a limit."""
    own = positions.join(nodes.where(F.col("node_type") == kind).select("node"), "node")
    own = own if before is None else own.where(F.col("frame") < before)
    return speeds(own).groupBy("sim").agg((F.sqrt(F.avg(F.col("speed") * F.col("speed"))) + floor).alias("step"))


def fit_standardizer(values: DataFrame, column: str, keys: Sequence[str], floor: float = 1e-8) -> DataFrame:
    """(keys, mean, std) from count, sum and sum of squares."""
    n, s, q = F.count(column), F.sum(column), F.sum(F.col(column) * F.col(column))
    return values.groupBy(*keys).agg((s / n).alias("mean"), F.greatest(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), F.lit(floor)).alias("std"))


def clean_level(scores: DataFrame, q: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, level): quantile of clean scores."""
    return quantile(scores, keys, "score", q, "level")


def bundle_features(positions: DataFrame, nodes: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(sim, frame, name, value): log1p of the 50, 90, 99 and 100 % points over plate nodes of speed, acceleration,
    laplacian and velocity laplacian by step, the number of inverted tets, and the greatest contact depth by step (18 in all);
    frames from the third on. The four kinds come by one window over a node's frames, one aggregation of the neighbours and one of
    a frame's plate nodes; all steps are by run."""
    step, seen = kept(step_scale(positions, nodes)), F.col("frame") >= 2
    at = positions.join(nodes.select("node", "rx", "ry", "rz"), "node")
    moved = at.select(*KEYS, *[(F.col(c) - F.col(f"r{c}")).alias(f"u{c}") for c in "xyz"], *[(F.col(c) - _lag(c, 1)).alias(f"v{c}") for c in "xyz"], *[(F.col(c) - (2 * _lag(c, 1) - _lag(c, 2))).alias(f"d{c}") for c in "xyz"])
    length = lambda n: norm3(*[F.col(f"{n}{c}") for c in "xyz"])
    flat, alone = [f"{n}{c}" for n in "uv" for c in "xyz"], ["speed", "acceleration"]
    sent = moved.where(seen).select("sim", "frame", F.col("node").alias("src"), *flat, length("v").alias("speed"), length("d").alias("acceleration")).join(linked(nodes, edges), "src")
    own = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    off = [(own(c) - F.coalesce(F.avg(F.when(~F.col("own"), F.col(c))), F.lit(0.0))).alias(c) for c in flat]
    met = sent.groupBy("sim", "frame", "dst").agg(*off, *[own(c).alias(c) for c in alone]).select("sim", "frame", *alone, length("u").alias("laplacian"), length("v").alias("vlap"))
    kinds, names = (*alone, "laplacian", "vlap"), ("50", "90", "99", "100")
    points = met.groupBy("sim", "frame").agg(*[F.percentile(k, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.99, 1.0)])).alias(k) for k in kinds]).join(step, "sim")
    each = F.array(*[F.struct(F.lit(f"{k}_{n}").alias("name"), F.log1p(F.get(k, F.lit(i)) / (F.col("step") + 1e-12)).alias("value")) for k in kinds for i, n in enumerate(names)])
    tall = points.select("sim", "frame", F.explode(each).alias("e")).select("sim", "frame", "e.name", "e.value").where(F.col("value").isNotNull())
    inverted = jacobian_frame_scores(jacobian_scores(positions, nodes, cells), nodes).select("sim", "frame", F.lit("inverted").alias("name"), F.log1p("score").alias("value"))
    deepest = contact_scores(positions, nodes, cells).groupBy("sim", "frame").agg(F.max("score").alias("d")).join(step, "sim")
    depth = deepest.select("sim", "frame", F.lit("depth").alias("name"), F.log1p(F.col("d") / (F.col("step") + 1e-12)).alias("value"))
    return kept(tall).unionByName(kept(inverted.where(seen))).unionByName(kept(depth.where(seen)))  # a job each, so that a task's code fits Spark's cache


def plate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == NORMAL).select("node")


def stride(df: DataFrame, start: int, stop: int, step: int) -> DataFrame:
    """Every step-th frame of [start, stop)."""
    return df.where((F.col("frame") >= start) & (F.col("frame") < stop) & ((F.col("frame") - start) % step == 0))


def contact_scores(positions: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Depth of plate nodes inside the actuator, 0 elsewhere (and for all other nodes). Only nodes within the actuator's box at
    their frame are held against its surface."""
    typed = positions.join(nodes.select("node", "node_type"), "node")
    box = typed.where(F.col("node_type") == OBSTACLE).groupBy("sim", "frame").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    inside = typed.where(F.col("node_type") == NORMAL).join(box, ["sim", "frame"])
    for c in "xyz":
        inside = inside.where((F.col(c) >= F.col(f"lo{c}")) & (F.col(c) <= F.col(f"hi{c}")))
    depth = signed_distance(positions, nodes, cells, points=inside.select(*KEYS)).select(*KEYS, F.greatest(-F.col("distance"), F.lit(0.0)).alias("d"))
    return positions.select(*KEYS).join(depth, list(KEYS), "left").select(*KEYS, F.coalesce("d", F.lit(0.0)).alias("score"))


def hotspot_nodes(scores: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(sim, frame, node, score, rank): the k highest plate nodes of each frame."""
    own = scores.join(plate_nodes(nodes), "node")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("sim", "frame").orderBy(F.desc("score"), "node"))).where(F.col("rank") <= k)


def diagnostics(positions: DataFrame, nodes: DataFrame, cells: DataFrame, pixels: DataFrame, levels: DataFrame, k: int = 10, size: float = 448.0) -> DataFrame:
    """(sim, frame, ratio, n_high, n_inverted, gap_mm, speed_ratio, row, col) of each frame from the third on: the frame's residual
    by its run's typical level, plate nodes over five times the median residual, inverted tets, and of the hot spot (the k
    plate nodes of highest residual) the least distance to an actuator node in mm (places are in m), the mean speed by the plate's median, and the
    cell of the 3 x 3 image grid. levels: (sim, level). pixels: (sim, frame, node, px, py)."""
    state = ["sim", "frame"]
    moved = positions.join(nodes.select("node", "node_type"), "node").select(*KEYS, "node_type", *"xyz", *[_lag(c, n).alias(f"{c}{n}") for c in "xyz" for n in (1, 2)])
    residual = norm3(*[F.col(c) - (2 * F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"])
    own = moved.where((F.col("node_type") == NORMAL) & F.col("x1").isNotNull()).select(*KEYS, *"xyz", residual.alias("score"), norm3(*[F.col(c) - F.col(f"{c}1") for c in "xyz"]).alias("speed"))
    every = Window.partitionBy(*state)
    placed = own.join(pixels.select(*KEYS, "px", "py"), list(KEYS), "left").withColumn("r", F.row_number().over(every.orderBy(F.desc_nulls_last("score"), "node"))).withColumn("m", median(F.col("score")).over(every))
    hot = (F.col("r") <= k) & F.col("score").isNotNull()
    tools = positions.join(nodes.where(F.col("node_type") == OBSTACLE).select("node"), "node").select(*state, *[F.col(c).alias(f"b{c}") for c in "xyz"])
    gap = placed.where(hot).select(*state, *"xyz").join(tools, state).groupBy(*state).agg(F.min(norm3(*[F.col(c) - F.col(f"b{c}") for c in "xyz"]) * 1000).alias("gap_mm"))
    of_hot = lambda c: F.avg(F.when(hot, F.col(c)))
    cell = lambda c: F.least(F.greatest(F.floor(of_hot(c) * 3 / size), F.lit(0)), F.lit(2)).cast("int")
    found = placed.groupBy(*state).agg(F.avg(F.when(F.col("r") <= 5, F.col("score"))).alias("top"), F.sum((F.col("score") > 5 * F.col("m")).cast("int")).alias("n_high"), (of_hot("speed") / (median(F.col("speed")) + 1e-12)).alias("speed_ratio"), cell("py").alias("row"), cell("px").alias("col"))
    found = found.where(F.col("top").isNotNull() & F.col("row").isNotNull()).join(levels, "sim").withColumn("ratio", F.col("top") / (F.col("level") + 1e-12)).join(gap, state)
    bad = inverted_cells(positions, nodes, cells).groupBy(*state).agg(F.count(F.lit(1)).alias("n_inverted"))
    return found.join(bad, state, "left").fillna(0, ["n_inverted"]).select(*state, "ratio", "n_high", "n_inverted", "gap_mm", "speed_ratio", "row", "col")


def color_limits(residuals: DataFrame, frames: Sequence[int], q: float = 0.995, factor: float = 3.0) -> DataFrame:
    """(sim, limit): factor times the quantile of plate residuals on a few clean frames."""
    return residuals.where(F.col("frame").isin(list(frames))).groupBy("sim").agg((factor * F.percentile("score", F.lit(q))).alias("limit"))


def patch_lookup(pixels: DataFrame, patches: DataFrame, grid: int, size: float) -> DataFrame:
    """pixels (item, node, px, py) with the score of the patch (item, row, col, score) that holds each."""
    place = lambda c: F.least(F.greatest(F.floor(F.col(c) / size * grid), F.lit(0)), F.lit(grid - 1)).cast("int")
    return pixels.withColumn("row", place("py")).withColumn("col", place("px")).join(patches, ["item", "row", "col"]).select("item", "node", "score")


def pixel_shift(clean: DataFrame, copy: DataFrame, keys: Sequence[str] = ("sim", "frame")) -> DataFrame:
    """(keys, shift): largest distance in pixels of a node (px, py) from its clean twin."""
    other = copy.select(*keys, "node", F.col("px").alias("qx"), F.col("py").alias("qy"))
    d = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    return clean.join(other, [*keys, "node"]).groupBy(*keys).agg(F.max(d).alias("shift"))
