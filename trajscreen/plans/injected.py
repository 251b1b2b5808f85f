"""Registered queries over injected copies and fitted models: rows only, or with SQL where the result is determined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.lineage import cut, kept
from trajscreen.operators import alarms, answers, copies, detect, inject, mesh, metrics, runs
from trajscreen.plans.fixtures import oracle, view
from trajscreen.plans.screening import _E, CALIB, CONSTVEL, COPY, DEPTH, GAP, LAP, MATRIX, PX, PY, STEPS, VLAP, by_run, changed, registered, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ONSET = (15, 40)


def query(name: str, sql: str | None = None, zero: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    return registered(name, sql, zero, QUERIES, ORACLE_SQL)


def _base(spark: SparkSession, sf_dir: str):
    p, r, c = (view(spark, sf_dir, n) for n in ("positions", "rest", "cells"))
    copies = inject.plan_copies(p.select("sim").distinct(), onset=ONSET)
    return p, r, c, mesh.mesh_edges(c), copies


def _patched(spark, d, kind: str, steps: int):
    p, r, _, edges, copies = _base(spark, d)
    own = copies.where(F.col("type") == kind)
    return p, r, inject.patch(own, inject.moving_centres(own, p, r), edges, r, steps)


@query("i1_moving_centres")
def i1(spark, d):
    p, r, _, _, copies = _base(spark, d)
    return inject.moving_centres(copies, p, r)


@query("i2_hourglass")
def i2(spark, d):
    p, r, patched = _patched(spark, d, "hourglass", 2)
    return inject.inject_hourglass(patched, p, detect.step_scale(p, r))


@query("i3_penetration")
def i3(spark, d):
    p, r, c, _, copies = _base(spark, d)
    own = inject.contact_onsets(copies.where("type = 'penetration'"), mesh.min_gap(p, r), ONSET)
    return inject.inject_penetration(own, p, r, c, detect.step_scale(p, r))


@query("i4_inversion")
def i4(spark, d):
    p, r, c, _, copies = _base(spark, d)
    own = copies.where("type = 'inversion'")
    return inject.inject_inversion(own, inject.moving_centres(own, p, r), p, r, c)


@query("i5_instability")
def i5(spark, d):
    p, r, patched = _patched(spark, d, "instability", 1)
    return inject.inject_instability(patched, p, detect.step_scale(p, r))


@query("i6_frozen")
def i6(spark, d):
    p, _, patched = _patched(spark, d, "frozen", 2)
    return inject.inject_frozen(patched, p)


@query("i8_blowup")
def i8(spark, d):
    p, r, _, edges, _ = _base(spark, d)
    lengths = mesh.run_lengths(p)
    plan = inject.plan_blowups(p.select("sim").distinct(), inject.acceleration_floor(p, r, lengths), detect.step_scale(p, r), lengths, cap=2.0, onset=12)
    return inject.inject_blowup(inject.patch(plan, inject.moving_centres(plan, p, r), edges, r, 1), p)


@query("i11_counterfactual_pairs")
def i11(spark, d):
    p, r, _, edges, _ = _base(spark, d)
    plan = p.select("sim").distinct().select("sim", F.lit("hourglass").alias("type"), F.lit(3).alias("sev"), (F.col("sim") * 100 + 3).alias("seed"), F.lit(38).alias("t0"))
    deltas = inject.inject_hourglass(inject.patch(plan, inject.moving_centres(plan, p, r), edges, r, 2), p, detect.step_scale(p, r))
    return inject.counterfactual_pairs(p, mesh.apply_deltas(p, deltas), 40)


LOCAL = ("constvel", "laplacian", "vlap", "velocity")
#: Three copies of each run under the number 10 * sim + sev, each with deltas of its own.
THREE = """, dl AS (SELECT sim*10 + sev AS sim, frame, node, x + sev*5e-1 AS x, y, z - 25e-2 AS z FROM positions, (VALUES (1), (2), (3)) AS s(sev) WHERE (sim*7 + frame*3 + node*sev) % 101 = sev AND node <= 4),
cs AS (SELECT p.sim*10 + sev AS sim, p.frame, p.node, coalesce(d.x, p.x) AS x, coalesce(d.y, p.y) AS y, coalesce(d.z, p.z) AS z FROM positions p CROSS JOIN (VALUES (1), (2), (3)) AS s(sev) LEFT JOIN dl d ON d.sim = p.sim*10 + sev AND d.frame = p.frame AND d.node = p.node)"""
NEAR = """, w1 AS (SELECT DISTINCT sim, frame + k AS frame, node FROM dl, (VALUES (0), (1), (2)) AS o(k)), w2 AS (SELECT DISTINCT sim, frame, node FROM dl UNION SELECT sim, frame, dst FROM dl JOIN edges ON node = src),
w3 AS (SELECT sim, frame + k AS frame, node FROM w2, (VALUES (0), (1)) AS o(k) GROUP BY ALL), w4 AS (SELECT DISTINCT sim, node FROM dl)"""
SPARSE = (THREE + CONSTVEL + LAP + VLAP).replace("positions", "cs").replace(THREE.replace("positions", "cs"), THREE) + NEAR
SPARSE += ", vl AS (SELECT sim, frame, node, dev / (14826e-4*quantile_cont(dev, 0.5) OVER (PARTITION BY sim, node) + 1e-9) AS score FROM (SELECT *, abs(speed - quantile_cont(speed, 0.5) OVER (PARTITION BY sim, node)) AS dev FROM speed) m)"
SPARSE += """ SELECT CAST(FLOOR(sim/10e0) AS BIGINT) AS sim, CAST(sim % 10 AS INT) AS sev, detector, frame, node, round(score, 5) AS score FROM (
  SELECT cv.sim, 'constvel' AS detector, cv.frame, cv.node, score FROM cv JOIN w1 USING (sim, frame, node) UNION ALL SELECT lap.sim, 'laplacian', lap.frame, lap.node, score FROM lap JOIN w2 USING (sim, frame, node)
  UNION ALL SELECT vlap.sim, 'vlap', vlap.frame, vlap.node, score FROM vlap JOIN w3 USING (sim, frame, node) UNION ALL SELECT vl.sim, 'velocity', vl.frame, vl.node, score FROM vl JOIN w4 USING (sim, node)) q"""


@query("i13_sparse_copy_scores", oracle(SPARSE, "positions", "edges"))
def i13(spark, d):
    def scores(p, r, c):
        three = p.withColumn("sev", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)]))).where("(sim*7 + frame*3 + node*sev) % 101 = sev and node <= 4")
        deltas = three.select("sim", F.lit("shift").alias("type"), "sev", "frame", "node", (F.col("x") + F.col("sev") * 0.5).alias("x"), "y", (F.col("z") - 0.25).alias("z"))
        return copies.changed_scores(p, deltas, r, mesh.mesh_edges(c), detectors=LOCAL).drop("type")

    return rounded(by_run(spark, d, scores), "score", digits=5)


BENCHED = 1 << 23  # rows of runs whose 15 copies are on disk at once, about


def benchmark_deltas(p: DataFrame, r: DataFrame, c: DataFrame, edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Sparse rows of all planned copies of the five kinds."""
    step, centres = kept(detect.step_scale(p, r)), kept(inject.moving_centres(plan, p, r))
    of = lambda kind, steps: inject.patch(plan.where(F.col("type") == kind), centres, edges, r, steps)
    pressed = kept(inject.contact_onsets(plan.where("type = 'penetration'"), kept(mesh.min_gap(p, r)), ONSET))
    parts = [inject.inject_hourglass(of("hourglass", 2), p, step), inject.inject_instability(of("instability", 1), p, step), inject.inject_frozen(of("frozen", 2), p), inject.inject_inversion(plan.where("type = 'inversion'"), centres, p, r, c), inject.inject_penetration(pressed, p, r, c, step)]
    out = kept(parts[0])
    for part in parts[1:]:
        out = out.unionByName(kept(part))
    return out


def _planned(p: DataFrame, r: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse rows of each run's 15 copies, and (sim, type, sev, frame, label, phase) of their event frames and clean ones near them."""
    plan = kept(inject.plan_copies(p.select("sim").distinct(), onset=ONSET))
    deltas = benchmark_deltas(p, r, c, mesh.mesh_edges(c), plan)
    return deltas, kept(inject.choose_frames(deltas.select("sim", "type", "sev", "frame").distinct(), t_max=mesh.run_lengths(p)))


def benchmark_records(spark: SparkSession, d: str) -> DataFrame:
    """(sim, type, sev, frame, label, phase, detector, score): the frame-level benchmark. Every run's 15 copies are planned and
    injected as sparse rows, event frames and clean ones near them chosen, only what the deltas can change scored anew, scores
    calibrated by node, and the planned frames scored; of the scores only those of planned frames and of calibration are held."""

    def records(p, r, c):
        deltas, frames = _planned(p, r, c)
        edges, plate, levels = mesh.mesh_edges(c), detect.plate_nodes(r), F.col("frame") % 10 == 5
        used = frames.select("sim", "frame").distinct()
        copy = frames.select("sim", "type", "sev").distinct()
        asked = kept(frames.select("sim", "type", "sev", "frame").unionByName(copy.join(p.where(levels).select("sim", "frame").distinct(), "sim").select("sim", "type", "sev", "frame")).distinct())
        clean = copies.clean_scores(p, r, edges, LOCAL).join(plate, "node")
        clean = kept(clean.join(used.withColumn("used", F.lit(True)), ["sim", "frame"], "left").where(levels | F.col("used")).select("sim", "detector", "frame", "node", "score"))
        new = kept(copies.changed_scores(p, deltas, r, edges, detectors=LOCAL, asked=asked).join(plate, "node"))
        return copies.calibrated_records(frames, clean, new, r, CALIB)

    return by_run(spark, d, records, BENCHED)


@query("e1_frame_benchmark")
def e1(spark, d):
    return rounded(metrics.known_cell_metrics(benchmark_records(spark, d), inject.TYPES, tuple(inject.SEVERITIES), LOCAL), "auroc", "tpr")


@query("i12_pick_frames")
def i12(spark, d):
    p = view(spark, d, "positions")
    ev = p.select("sim").distinct().select("sim", F.explode(F.sequence(F.expr("cast(20 + sim % 7 as int)"), F.expr("cast(29 + sim % 11 as int)"))).alias("frame"))
    return inject.pick_frames(inject.choose_frames(ev, t_max=mesh.run_lengths(p), keys=("sim",)), keys=("sim",))


@query("j3_contact_pairs", oracle(" SELECT sim, plate, actuator, round(d, 6) AS distance FROM (SELECT a.node AS plate, b.node AS actuator, sqrt((a.rx-b.rx)*(a.rx-b.rx)+(a.ry-b.ry)*(a.ry-b.ry)+(a.rz-b.rz)*(a.rz-b.rz)) AS d, row_number() OVER (PARTITION BY a.node ORDER BY sqrt((a.rx-b.rx)*(a.rx-b.rx)+(a.ry-b.ry)*(a.ry-b.ry)+(a.rz-b.rz)*(a.rz-b.rz)), b.node) AS r FROM rest a, rest b WHERE a.node <= 4 AND b.node >= 5) q, (SELECT DISTINCT sim FROM positions) s WHERE d <= 305e-1 AND r <= 2", "positions"))
def j3(spark, d):
    p, r = (view(spark, d, n) for n in ("positions", "rest"))
    nodes = p.select("sim", "node").distinct().join(r, "node")
    return rounded(mesh.contact_pairs(nodes, 30.5, 2, ("sim",)), "distance")


SUNK = ", sk AS (SELECT sim, frame, node, x, y, CASE WHEN node = 0 AND frame % 10 = 0 THEN z - 3e0 ELSE z END AS z FROM positions)"


def sunk(p: DataFrame) -> DataFrame:
    """Positions with node 0 pushed into the actuator on every tenth frame."""
    return p.withColumn("z", F.when((F.col("node") == 0) & (F.col("frame") % 10 == 0), F.col("z") - 3.0).otherwise(F.col("z")))


def _of(*names: str) -> list[str]:
    return [f"{n}{c}" for n in names for c in "xyz"]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"({x})*({y})" for x, y in zip(u, v, strict=True)) + ")"


def _less(u: str, v: str) -> list[str]:
    return [f"({u}{c}-{v}{c})" for c in "xyz"]


def _crossed(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[1]}*{v[2]}-{u[2]}*{v[1]})", f"({u[2]}*{v[0]}-{u[0]}*{v[2]})", f"({u[0]}*{v[1]}-{u[1]}*{v[0]})"]


FACE = ("qa", "qb", "qc")
SIDES = (("qa", "qb"), ("qb", "qc"), ("qc", "qa"))
#: Signed distances of plate nodes to the actuator's one tet in SQL: the closest of its four faces, inside where the depth is above 0.
SIGNED = DEPTH + """, fc AS (SELECT * FROM (VALUES (5,6,7),(5,6,8),(5,7,8),(6,7,8)) AS f(fa,fb,fd)),
t0 AS (SELECT p.sim, p.frame, p.node, p.x AS px, p.y AS py, p.z AS pz, """ + ", ".join(f"{n}.{c} AS {n}{c}" for n in FACE for c in "xyz") + " FROM positions p CROSS JOIN fc " + " ".join(f"JOIN positions {n} ON {n}.node = {f} AND {n}.sim = p.sim AND {n}.frame = p.frame" for n, f in zip(FACE, ("fa", "fb", "fd"), strict=True)) + """ WHERE p.node <= 4),
t1 AS (SELECT *, """ + ", ".join(f"{x} AS n{c}" for x, c in zip(_crossed(_less("qb", "qa"), _less("qc", "qa")), "xyz", strict=True)) + " FROM t0), t2 AS (SELECT *, " + f"{_dot(_less('p', 'qa'), _of('n'))} / {_dot(_of('n'), _of('n'))} AS height, " + ", ".join(f"least(greatest({_dot(_less('p', u), _less(v, u))} / {_dot(_less(v, u), _less(v, u))}, 0e0), 1e0) AS s{i}" for i, (u, v) in enumerate(SIDES)) + " FROM t1), t3 AS (SELECT *, " + ", ".join(f"p{c} - height*n{c} AS f{c}" for c in "xyz") + ", " + ", ".join("sqrt(" + " + ".join(f"power(p{c} - ({u}{c} + s{i}*({v}{c}-{u}{c})), 2)" for c in "xyz") + f") AS d{i}" for i, (u, v) in enumerate(SIDES)) + " FROM t2), t4 AS (SELECT sim, frame, node, CASE WHEN " + " AND ".join(f"{_dot(_crossed(_less(v, u), _less('f', u)), _of('n'))} >= 0" for u, v in SIDES) + f" THEN least(d0, d1, d2, sqrt({_dot(_less('p', 'f'), _less('p', 'f'))})) ELSE least(d0, d1, d2) END AS d FROM t3)" + """,
sd AS (SELECT t4.sim, t4.frame, t4.node, CASE WHEN max(depth) > 0 THEN -min(d) ELSE min(d) END AS distance FROM t4 JOIN dp ON t4.sim = dp.sim AND t4.frame = dp.frame AND t4.node = dp.node GROUP BY t4.sim, t4.frame, t4.node)"""


@query("j8_signed_distance", oracle(SUNK + SIGNED.replace("positions", "sk") + " SELECT sim, frame, node, round(distance, 6) AS distance FROM sd", "positions"))
def j8(spark, d):
    return rounded(by_run(spark, d, lambda p, r, c: mesh.signed_distance(sunk(p), r, c)), "distance")


@query("r2_contact_run_stats", oracle(SUNK + (SIGNED + STEPS).replace("positions", "sk") + """, st AS (SELECT sim, sqrt(avg(speed*speed)) AS step FROM speed WHERE node >= 5 GROUP BY sim), g AS (SELECT sim, frame, min(distance) AS gap FROM sd GROUP BY sim, frame)
SELECT g.sim, round(quantile_cont(gap, 0.5) / step, 5) AS contact_gap, round(max(greatest(0e0, -gap)) / step, 5) AS contact_depth FROM g JOIN st ON g.sim = st.sim GROUP BY g.sim, step""", "positions"))
def r2(spark, d):
    def stats(p, r, c):
        gaps = mesh.signed_distance(sunk(p), r, c).groupBy("sim", "frame").agg(F.min("distance").alias("gap"))
        return alarms.contact_run_stats(gaps, detect.step_scale(p, r, mesh.OBSTACLE))

    return rounded(by_run(spark, d, stats), "contact_gap", "contact_depth", digits=5)


@query("d7_contact_scores", oracle(SUNK + DEPTH.replace("positions", "sk") + " SELECT s.sim, s.frame, s.node, round(coalesce(depth, 0), 6) AS score FROM sk s LEFT JOIN dp ON s.sim = dp.sim AND s.frame = dp.frame AND s.node = dp.node", "positions"))
def d7(spark, d):
    p, r, c = (view(spark, d, n) for n in ("positions", "rest", "cells"))
    return rounded(detect.contact_scores(sunk(p), r, c), "score")


def _scored_runs(spark, d, grid=runs.GRID) -> DataFrame:
    p, r, c = (view(spark, d, n) for n in ("positions", "rest", "cells"))
    return runs.score_runs(p, r, c, mesh.mesh_edges(c), (10, 2**31 - 1, 2), grid, rows=view(spark, d, "lineitem").count())


@query("r5_score_runs")
def r5(spark, d):
    return rounded(_scored_runs(spark, d), "value")


RULES = ("constvel", "laplacian", "velocity", "vlap", "contact_gap", "contact_depth")
BY_MODEL = {"step": ("residual",), "shape": ("shape_scale", "shape_resid"), "rough": ("rough_resid",)}


def _second(p: DataFrame) -> DataFrame:
    each = [c for c in p.columns if c not in ("frame", *"xyz")]  # with the columns that tell copies apart
    order = Window.partitionBy("sim", "node", *[c for c in each if c not in ("sim", "node")]).orderBy("frame")
    return p.select(*each, "frame", *[(F.col(c) - 2 * F.lag(c, 1).over(order) + F.lag(c, 2).over(order)).alias(f"a{c}") for c in "xyz"]).where("ax is not null")


def _models(p: DataFrame, r: DataFrame, c: DataFrame):
    """Stand-ins for the surrogates' predictions: one of accelerations, 80 % of the true ones, and one of displacements, the clean
    run's own but for 5 % (it sees the load, not the error). With their errors, and those of one that is too rough to be admitted."""
    keys = lambda q: [k for k in q.columns if k not in "xyz"]
    step = lambda q: _second(q).select(*keys(q), *[(F.col(f"a{k}") * 0.8).alias(f"a{k}") for k in "xyz"])
    u = mesh.displacement(p, r).where("node_type = 0").select("sim", "frame", "node", *[(F.col(f"u{k}") * 0.95).alias(f"u{k}") for k in "xyz"])
    shape = lambda q: q.select(*keys(q)).join(u, ["sim", "frame", "node"])
    each = lambda df, name, share, columns: df.select(F.lit(name).alias("surrogate"), F.explode(F.array(*columns)).alias("target")).select("surrogate", (F.col("target") * share).alias("prediction"), "target", F.lit(True).alias("mask"))
    moved = mesh.displacement(p, r).where("node_type = 0")
    errors = each(_second(p), "step", 0.8, ["ax", "ay", "az"]).unionByName(each(moved, "shape", 0.95, ["ux", "uy", "uz"])).unionByName(each(moved, "rough", 0.3, ["ux", "uy", "uz"]))
    return step, shape, errors


@query("r6_admission", oracle("""SELECT surrogate, round(sqrt(avg((f-1)*(f-1)*t*t)) / sqrt(avg(t*t)), 6) AS ratio, sqrt(avg((f-1)*(f-1)*t*t)) <= 5e-1*sqrt(avg(t*t)) AS admitted FROM (
  SELECT 'step' AS surrogate, 8e-1 AS f, unnest([x - 2*lag(x, 1) OVER t + lag(x, 2) OVER t, y - 2*lag(y, 1) OVER t + lag(y, 2) OVER t, z - 2*lag(z, 1) OVER t + lag(z, 2) OVER t]) AS t FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)
  UNION ALL SELECT m.s, m.f, unnest([x - rx, y - ry, z - rz]) FROM positions p JOIN rest ON p.node = rest.node CROSS JOIN (VALUES ('shape', 95e-2), ('rough', 3e-1)) AS m(s, f) WHERE node_type = 0) q WHERE t IS NOT NULL GROUP BY surrogate""", "positions"))
def r6_admission(spark, d):
    errors = _models(*(view(spark, d, n) for n in ("positions", "rest", "cells")))[2]
    return rounded(metrics.rmse_vs_baseline(errors, "prediction", "target", "mask", ["surrogate"]).select("surrogate", "ratio", "admitted"), "ratio")


@query("r6_gate_runs")
def r6(spark, d):
    """Statistics of the admitted surrogates against the best rule of each cell."""
    p, r, c = (view(spark, d, n) for n in ("positions", "rest", "cells"))
    rows = view(spark, d, "lineitem").count()
    p = runs.dealt(p, runs.dealing(spark, rows, 1 + sum(map(len, runs.GRID.values()))))
    step, shape, errors = _models(p, r, c)
    every = runs.score_runs(p, r, c, mesh.mesh_edges(c), (10, 2**31 - 1, 2), residual=step, shape=shape, rows=rows, lying=True)
    clean = every.where("kind = 'clean'").select("detector", "value")
    z = cut(alarms.robust_z(every, clean).select("sim", "kind", "parameter", "detector", "z"))
    return rounded(alarms.gate_runs(z, alarms.admitted(errors, BY_MODEL), RULES), "delta", "lo", "p")


@query("r4_spread_table")
def r4b(spark, d):
    scored = _scored_runs(spark, d, {"lag": (10,)})  # of the grid, the table reads the clean runs and this error only
    return rounded(alarms.spread_table(scored.where("kind = 'clean'").select("sim", "detector", "value"), scored.where("kind = 'lag' and parameter = 10").select("sim", "detector", "value")), "clean_cv", "median_shift")


def _triage(spark, d) -> DataFrame:
    return answers.triage_features(view(spark, d, "tall"), ["a", "b"]).withColumn("item", F.concat_ws("-", "sim", "frame", "kind", "sev"))


def _tempered(model: answers.Triage, calibration: DataFrame) -> float:
    probs = answers.predict_triage(model, calibration).select("probs", answers.truth_index(model, F.col("kind")).alias("truth_index"))
    return answers.fit_temperature(probs.where("truth_index is not null").persist())


@query("t2_triage_predictions")
def t2(spark, d):
    features = _triage(spark, d)
    model = answers.fit_triage(features.where("sim % 3 = 0"), ["a", "b"])
    return answers.predict_triage(model, features.where("sim % 3 > 0")).select("sim", "frame", "kind", "pred", F.round("conf", 6).alias("conf"))


@query("t3_temperature")
def t3(spark, d):
    features = _triage(spark, d)
    model = answers.fit_triage(features.where("sim % 3 = 0"), ["a", "b"])
    calibration = features.where("sim % 3 = 1")
    return calibration.agg(F.count(F.lit(1)).alias("n")).withColumn("temperature", F.round(F.lit(_tempered(model, calibration)), 6))


EVALUATED = ("accuracy", "macro_f1", "ece", "brier", "acc_at_coverage", "coverage", "tau")


@query("t4_evaluate_triage")
def t4(spark, d):
    features = _triage(spark, d)
    model = answers.fit_triage(features.where("sim % 3 = 0"), ["a", "b"])
    tempered = answers.predict_triage(model, features.where("sim % 3 = 2"), _tempered(model, features.where("sim % 3 = 1")))
    return rounded(answers.evaluate_triage(tempered, model), *EVALUATED)


SHIFTED = ("accuracy", "macro_f1", "ece", "brier", "acc_at_coverage", "coverage", "temperature", "tau")


def _parts(spark, d) -> list[DataFrame]:
    """Triage rows to fit, to calibrate and to test on, by disjoint runs."""
    features = cut(_triage(spark, d))
    return [features.where(F.col("sim") % 3 == i) for i in range(3)]


@query("t5_heldout_severity")
def t5(spark, d):
    return rounded(answers.heldout_severity(*_parts(spark, d), ["a", "b"]), *SHIFTED)


@query("t5_heldout_type")
def t5b(spark, d):
    parts = _parts(spark, d)
    both = [answers.heldout_type(*parts, ["a", "b"], kind) for kind in ("frozen", "penetration")]
    return rounded(both[0].unionByName(both[1]), "abstain_rate", *SHIFTED)


def _diagnosed(positions: DataFrame, r: DataFrame, c: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    pixels = mesh.project(positions, MATRIX).select("sim", "frame", "node", "px", "py")
    if levels is None:
        levels = detect.frame_scores(detect.constvel_scores(positions), r).groupBy("sim").agg(F.percentile("score", F.lit(0.95)).alias("level"))
    return detect.diagnostics(positions, r, c, pixels, levels)


@query("t6_diagnostic_tree")
def t6(spark, d):
    """Every planned frame of the 15 copies of each run, event and clean ones, diagnosed from its own frame and the two before."""

    def diagnosed(p, r, c):
        deltas, frames = _planned(p, r, c)
        of_copy = F.struct("type", "sev", "frame").alias("frame")  # so that a run's copies stay with it
        states = frames.select("sim", of_copy, "label")
        needed = frames.select("sim", "type", "sev", F.explode(F.sequence(F.col("frame") - 2, F.col("frame"))).alias("frame")).distinct()
        rows = needed.join(p, ["sim", "frame"]).select("sim", of_copy, "node", "x", "y", "z")
        local = kept(mesh.apply_deltas(rows, deltas.select("sim", of_copy, "node", "x", "y", "z")))
        levels = kept(detect.frame_scores(detect.constvel_scores(p), r).groupBy("sim").agg(F.percentile("score", F.lit(0.95)).alias("level")))
        # a node's frames lie in order by copy: the two before a planned one are its copy's own, and only planned ones are taken
        found = _diagnosed(local, r, c, levels).join(states, ["sim", "frame"])
        return found.select("sim", "frame.type", "frame.sev", "frame.frame", *[x for x in found.columns if x not in ("sim", "frame")])

    found = by_run(spark, d, diagnosed, BENCHED)
    found = found.withColumn("kind", F.when(F.col("label"), F.col("type")).otherwise("none")).withColumn("item", F.concat_ws("-", "sim", "type", "sev", "frame"))
    return answers.diagnostic_tree_cv(found.withColumn("location", F.concat_ws("-", "row", "col")), ["ratio", "n_high", "n_inverted", "gap_mm", "speed_ratio"], carry=("location",))


PROMPT = ", gp AS (SELECT a.sim, a.frame, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS gap FROM positions a JOIN positions b ON a.sim = b.sim AND a.frame = b.frame WHERE a.node <= 4 AND b.node >= 5 GROUP BY a.sim, a.frame)"


@query("x5_prompts", oracle(PROMPT + " SELECT sim, frame, 'Frame ' || frame || ' of run ' || sim || ':' || CASE WHEN frame % 7 <> 0 THEN ' gap ' || CAST(round(gap, 3) AS DECIMAL(12,3)) || ' mm; ' ELSE '' END || CASE WHEN frame % 7 <> 0 THEN 'answer in JSON.' ELSE 'answer in JSON.' END AS prompt FROM gp", "positions"))
def x5(spark, d):
    gaps = mesh.min_gap(*(view(spark, d, n) for n in ("positions", "rest")))
    shown = gaps.withColumn("gap", F.when(F.col("frame") % 7 != 0, F.round("gap", 3).cast("decimal(12,3)")))
    return answers.render_prompt(shown, "Frame %s of run %s: gap %s mm; answer in JSON.", ["frame", "sim", "gap"]).select("sim", "frame", "prompt")


@query("w7_hotspot_nodes", oracle(GAP.replace(", gaps AS", ", unused AS") + """, cv AS (SELECT sim, frame, node, sqrt(dx*dx+dy*dy+dz*dz) AS score FROM (SELECT sim, frame, node, x - (2*lag(x, 1) OVER t - lag(x, 2) OVER t) AS dx, y - (2*lag(y, 1) OVER t - lag(y, 2) OVER t) AS dy, z - (2*lag(z, 1) OVER t - lag(z, 2) OVER t) AS dz FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)) q WHERE dx IS NOT NULL)
SELECT sim, frame, node FROM (SELECT *, row_number() OVER (PARTITION BY sim, frame ORDER BY score DESC, node) AS r FROM cv WHERE node <= 4) q WHERE r <= 2""", "positions"))
def w7(spark, d):
    p, r = (view(spark, d, n) for n in ("positions", "rest"))
    return detect.hotspot_nodes(detect.constvel_scores(p), r, 2).select("sim", "frame", "node")


@query("x6_diagnostics")
def x6(spark, d):
    return rounded(by_run(spark, d, _diagnosed), "ratio", "gap_mm", "speed_ratio", digits=5)


@query("c6_color_limits", oracle(""", cv AS (SELECT sim, frame, node, sqrt(dx*dx+dy*dy+dz*dz) AS score FROM (SELECT sim, frame, node, x - (2*lag(x, 1) OVER t - lag(x, 2) OVER t) AS dx, y - (2*lag(y, 1) OVER t - lag(y, 2) OVER t) AS dy, z - (2*lag(z, 1) OVER t - lag(z, 2) OVER t) AS dz FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)) q WHERE dx IS NOT NULL)
SELECT sim, round(3*quantile_cont(score, 0.995), 6) AS "limit" FROM cv WHERE node <= 4 AND frame IN (10, 20, 30, 40, 50) GROUP BY sim""", "positions"))
def c6(spark, d):
    p, r = (view(spark, d, n) for n in ("positions", "rest"))
    return rounded(detect.color_limits(detect.constvel_scores(p).join(detect.plate_nodes(r), "node"), (10, 20, 30, 40, 50)), "limit")


@query("p8_patch_lookup", oracle(f", px AS (SELECT sim*100 + frame AS item, node, {PX.format(m=_E)} AS px, {PY.format(m=_E)} AS py FROM positions) SELECT item, node, least(greatest(floor(py/448e0*4), 0), 3)*10e0 + least(greatest(floor(px/448e0*4), 0), 3) AS score FROM px", "positions"))
def p8(spark, d):
    p = view(spark, d, "positions")
    pixels = mesh.project(p, MATRIX).select((F.col("sim") * 100 + F.col("frame")).alias("item"), "node", "px", "py")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.floor(i / 4).cast("int").alias("row"), (i % 4).cast("int").alias("col"))))
    patches = pixels.select("item").distinct().select("item", cells.alias("c")).select("item", "c.row", "c.col", (F.col("c.row") * 10.0 + F.col("c.col")).alias("score"))
    return detect.patch_lookup(pixels, patches, 4, 448.0)


@query("p10_pixel_shift", oracle(COPY + f", a AS (SELECT sim, frame, node, {PX.format(m=_E)} AS px, {PY.format(m=_E)} AS py FROM positions), b AS (SELECT sim, frame, node, {PX.format(m=_E)} AS px, {PY.format(m=_E)} AS py FROM cp) SELECT a.sim, a.frame, round(max(sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))), 5) AS shift FROM a JOIN b ON a.sim = b.sim AND a.frame = b.frame AND a.node = b.node GROUP BY a.sim, a.frame", "positions"))
def p10(spark, d):
    p = view(spark, d, "positions")
    copy = mesh.apply_deltas(p, changed(p))
    return rounded(detect.pixel_shift(mesh.project(p, MATRIX), mesh.project(copy, MATRIX)), "shift", digits=5)


OFF = [f"(a.{c}-pl.r{c})" for c in "xyz"]
REST_OFF = [f"(a.r{c}-b.r{c})" for c in "xyz"]
LENGTH = lambda d: f"round(sqrt({'+'.join(k + '*' + k for k in d)}), 6) AS length"
LOADS = f"""SELECT a.sim, a.frame, ac.node AS src, pl.node AS dst, 'contact' AS kind, {', '.join(f'round({k}, 6) AS {c}' for k, c in zip(OFF, 'xyz', strict=True))}, {LENGTH(OFF)} FROM rest pl JOIN rest ac ON pl.node_type = 0 AND ac.node_type = 1 JOIN positions a ON a.node = ac.node
WHERE sqrt((pl.rx-ac.rx)*(pl.rx-ac.rx)+(pl.ry-ac.ry)*(pl.ry-ac.ry)+(pl.rz-ac.rz)*(pl.rz-ac.rz)) <= 205e-1"""


@query("p17_load_edge_features", oracle(f""", one AS ({LOADS}) SELECT * FROM one UNION ALL SELECT sim, frame, dst, src, kind, -x, -y, -z, length FROM one
UNION ALL SELECT sim, CAST(NULL AS INT), src, dst, 'mesh', {', '.join(f'round({k}, 6)' for k in REST_OFF)}, {LENGTH(REST_OFF)} FROM edges JOIN rest a ON a.node = src JOIN rest b ON b.node = dst, (SELECT DISTINCT sim FROM positions) s""", "positions", "edges"), zero=("x", "y", "z"))
def p17(spark, d):
    p, r, c = (view(spark, d, n) for n in ("positions", "rest", "cells"))
    contact = mesh.load_edge_features(p, r, mesh.contact_pairs(r, 20.5, 8)).withColumn("kind", F.lit("contact"))
    fixed = mesh.rest_edge_features(r, mesh.mesh_edges(c)).withColumn("kind", F.lit("mesh")).withColumn("frame", F.lit(None).cast("int"))
    sims = p.groupBy("sim").agg(F.max(F.lit(0)).alias("join_all"))
    return rounded(contact.unionByName(fixed.withColumn("join_all", F.lit(0)).join(sims, "join_all").drop("join_all")), "x", "y", "z", "length")
