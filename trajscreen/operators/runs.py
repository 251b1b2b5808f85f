"""Whole runs scored by many statistics over a grid of global errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import median, norm3
from trajscreen.functions.lineage import cut, holding, stored
from trajscreen.operators import alarms, detect, inject, mesh

#: Parameters of the global errors, by kind.
GRID: Mapping[str, Sequence[float]] = {"scale": (0.05, 0.1, 0.2), "lag": (2, 5, 10), "timescale": (0.95, 0.9, 0.8)}


DEALT = 1 << 19  # rows of runs that a task holds, about

TOGETHER = 1 << 25  # rows of copies that are on disk at once, about; a copy of its own may have more

#: A surrogate model: positions (sim, frame, node, x, y, z) to its predictions for their rows. Where positions hold several copies of
#: a run at once, a column copy tells these apart; predictions carry it on.
Surrogate = Callable[[DataFrame], DataFrame]


@contextmanager
def dealt_by_run(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Joins on sim and more, of tables dealt by sim, need no exchange for the jobs that run inside; plans aren't adapted there, as
    a checkpoint of an adapted plan forgets how its rows are dealt. The session's own settings come back."""
    now = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false"}
    if partitions:
        now["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in now}
    for name, value in now.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def dealt(positions: DataFrame, partitions: int | None = None) -> DataFrame:
    """positions, checkpointed with each run in one task."""
    spark = positions.sparkSession
    with dealt_by_run(spark, partitions):
        return cut(positions.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sim"))


def by_run(positions: DataFrame, job: Callable[[DataFrame], DataFrame], rows: int = 0, most: int | None = None) -> DataFrame:
    """job(positions), stored, of a job all of whose steps are by sim: runs are dealt over the tasks once and kept there on disk
    while the job runs, so that no step moves their rows. rows: about how many there are; a task gets about DEALT of them, however
    many there are in all. most: about how many rows of runs the job may be at work on at once: above that the runs are split by a
    hash of sim, and one part is done and dropped after the other."""
    spark = positions.sparkSession
    parts = -(-rows // most) if most else 1
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (max(parts, 1) * DEALT)))
    out = None
    for part in range(max(parts, 1)):
        own = positions if parts <= 1 else positions.where(F.pmod(F.xxhash64("sim"), F.lit(parts)) == part)
        with dealt_by_run(spark, partitions), holding(spark):
            held = own.repartition(partitions, "sim").persist(StorageLevel.DISK_ONLY)
            try:
                done = stored(job(held))
            finally:
                held.unpersist()
        out = done if out is None else out.unionByName(done)
    return out


def _top(column: str, k: int = 5) -> Column:
    """Mean of the k largest values of a group."""
    most = F.slice(F.sort_array(F.collect_list(column), asc=False), 1, k)
    return F.when(F.size(most) > 0, F.aggregate(most, F.lit(0.0), lambda t, x: t + x) / F.size(most))


def _statistics(positions: DataFrame, nodes: DataFrame, cells: DataFrame, edges: DataFrame, frames: Sequence[int], residual: Surrogate | None, shape: Surrogate | None, copy: Sequence[str]) -> list[DataFrame]:
    """The parts of run_statistics: those of the rules and the one-step prediction, of contact, and of shape."""
    run, own = ["sim", *copy], lambda df: detect.stride(df, *frames)
    each = ["sim", "node", *copy]  # in this order rows lie within a task
    node = Window.partitionBy(*each)
    lag = lambda c, n: F.lag(c, n).over(node.orderBy("frame"))
    at = positions.join(nodes.select("node", "node_type", "rx", "ry", "rz"), "node")
    moved = at.select(*each, "frame", "node_type", *[(F.col(c) - F.col(f"r{c}")).alias(f"u{c}") for c in "xyz"], *[(F.col(c) - lag(c, 1)).alias(f"v{c}") for c in "xyz"], *[(F.col(c) - (2 * lag(c, 1) - lag(c, 2))).alias(f"d{c}") for c in "xyz"])
    moved = moved.withColumn("speed", norm3(*[F.col(f"v{c}") for c in "xyz"]))
    mean_square = lambda kind: F.sqrt(F.avg(F.when(F.col("node_type") == kind, F.col("speed") * F.col("speed"))))
    steps = moved.groupBy(*run).agg(mean_square(mesh.NORMAL).alias("step"), (mean_square(mesh.OBSTACLE) + 1e-12).alias("tool_step"))
    scored = moved.withColumn("dev", F.abs(F.col("speed") - median(F.col("speed")).over(node)))
    scored = scored.withColumn("velocity", F.col("dev") / (detect.MAD * median(F.col("dev")).over(node) + 1e-9)).withColumn("constvel", norm3(*[F.col(f"d{c}") for c in "xyz"]))
    alone = ["constvel", "velocity"]
    if residual is not None:
        ahead = residual(positions).select(*each, "frame", "ax", "ay", "az")
        scored = scored.join(ahead, [*each, "frame"], "left").withColumn("residual", norm3(*[F.col(f"d{c}") - F.col(f"a{c}") for c in "xyz"]))
        alone.append("residual")
    flat = [f"{n}{c}" for n in "uv" for c in "xyz"]
    sent = own(scored).select(*run, "frame", F.col("node").alias("src"), *flat, *alone).join(mesh.linked(nodes, edges), "src")
    self_ = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    off = [(self_(c) - F.coalesce(F.avg(F.when(~F.col("own"), F.col(c))), F.lit(0.0))).alias(c) for c in flat]
    met = sent.groupBy(*run, "frame", "dst").agg(*off, *[self_(c).alias(c) for c in alone])
    met = met.select(*run, "frame", *alone, *[norm3(*[F.col(f"{n}{c}") for c in "xyz"]).alias(name) for n, name in (("u", "laplacian"), ("v", "vlap"))])
    names = ["constvel", "laplacian", "vlap", "velocity", *alone[2:]]
    tops = met.groupBy(*run, "frame").agg(*[_top(n).alias(n) for n in names])
    middle = tops.groupBy(*run).agg(*[median(F.col(n)).alias(n) for n in names]).join(steps, run).where("step is not null")
    tall = lambda df, columns: df.select(*run, F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), x.alias("value")) for n, x in columns.items()])).alias("s")).select(*run, "s.detector", "s.value")
    parts = [tall(middle, {n: F.when(F.col(n).isNotNull(), F.col(n) if n == "velocity" else F.col(n) / F.col("step")) for n in names}).where("value is not null")]
    gaps = mesh.signed_distance(own(positions), nodes, cells, state=[*run, "frame"]).groupBy(*run, "frame").agg(F.min("distance").alias("gap"))
    contact = alarms.contact_run_stats(gaps, steps.where("tool_step is not null").select(*run, F.col("tool_step").alias("step")), run)
    parts.append(tall(contact, {n: F.col(n) for n in ("contact_gap", "contact_depth")}))
    if shape is not None:
        observed = mesh.displacement(own(positions), nodes).where(F.col("node_type") == mesh.NORMAL).select(*each, "frame", "ux", "uy", "uz")
        both = alarms.shape_run_stats(observed, shape(own(positions)), (*each, "frame"), run)
        parts.append(tall(both, {n: F.col(n) for n in ("shape_scale", "shape_resid")}))
    return parts


def run_statistics(positions: DataFrame, nodes: DataFrame, cells: DataFrame, edges: DataFrame, frames: Sequence[int], residual: Surrogate | None = None, shape: Surrogate | None = None, copy: Sequence[str] = ()) -> DataFrame:
    """(sim, copy, detector, value) of whole runs: the median frame score of constvel, laplacian, vlap (by the plate's step) and
    velocity on the given frames (start, stop, step), and contact_gap and contact_depth by the actuator's step. With surrogates
    also the residual of a one-step prediction (sim, copy, frame, node, ax, ay, az), by the plate's step, and shape_scale and
    shape_resid against predicted displacements (sim, copy, frame, node, ux, uy, uz) of plate nodes. copy: columns that tell copies
    of a run apart. The detectors' scores (detect) are made together: one window over a node's frames, one aggregation of the
    neighbours for both Laplacians, and one of a frame's plate nodes."""
    out, *more = _statistics(positions, nodes, cells, edges, frames, residual, shape, copy)
    for part in more:
        out = out.unionByName(part)
    return out


def score_runs(positions: DataFrame, nodes: DataFrame, cells: DataFrame, edges: DataFrame, frames: Sequence[int], grid: Mapping[str, Sequence[float]] = GRID, residual: Surrogate | None = None, shape: Surrogate | None = None, rows: int = 0, lying: bool = False) -> DataFrame:
    """(sim, kind, parameter, detector, value): the statistics of each run as it is (kind clean, parameter 0) and under each error
    of the grid. Runs are dealt over the tasks once (lying: they are already); copies are made, scored together and dropped, as
    many at once as make TOGETHER rows, and as all steps are by run, none of their rows is moved. rows: about how many positions there are.
    A residual or shape that joins other tables does so by run too, where they are dealt."""
    spark = positions.sparkSession
    errors = [("clean", 0.0), *((kind, float(v)) for kind, values in grid.items() for v in values)]
    positions = positions if lying else dealt(positions, dealing(spark, rows, len(errors)))
    every, many = None, min(len(errors), max(1, TOGETHER // max(rows, 1)))
    with dealt_by_run(spark, positions.rdd.getNumPartitions()):
        for i in range(0, len(errors), many):
            some = errors[i : i + many]
            made = inject.inject_globals(positions, nodes, some)
            held = made.sortWithinPartitions("sim", "node", "copy", "frame").persist(StorageLevel.DISK_ONLY)
            of = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("parameter")) for kind, v in some])[F.col("copy")]
            for stats in _statistics(held, nodes, cells, edges, frames, residual, shape, ("copy",)):  # a job each, so that a task's code fits Spark's cache
                part = cut(stats.withColumn("of", of).select("sim", "of.kind", "of.parameter", "detector", "value"))
                every = part if every is None else every.unionByName(part)
            held.unpersist()
    return every


def dealing(spark: SparkSession, rows: int, copies: int) -> int:
    """Into how many tasks runs are dealt of which so many copies are scored, TOGETHER rows at once or one copy."""
    most = rows * min(copies, max(1, TOGETHER // max(rows, 1)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // DEALT))
