import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.functions.columns import jaccard, softmax, terms
from trajscreen.operators import alarms, answers, detect, inject, mesh, metrics, resample
from trajscreen.plans.fixtures import view
from trajscreen.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    p = view(spark, SF, "positions").where("sim <= 2").cache()
    return p, view(spark, SF, "rest"), view(spark, SF, "cells")


@pytest.fixture(scope="module")
def copies(toy):
    p, r, c = toy
    plan = inject.plan_copies(p.select("sim").distinct(), onset=(15, 40))
    return plan, inject.moving_centres(plan, p, r)


def moved(p, deltas):
    """Largest deviation by (sim, type, sev) and the nodes that deviate."""
    d = deltas.join(p.select("sim", "frame", "node", *[F.col(c).alias("p" + c) for c in "xyz"]), ["sim", "frame", "node"])
    return d.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2)))


def test_only_plate_nodes_change(toy, copies):
    p, r, c = toy
    plan, centres = copies
    edges, step = mesh.mesh_edges(c), detect.step_scale(p, r)
    of = lambda kind, n: inject.patch(plan.where(F.col("type") == kind), centres, edges, r, n)
    every = inject.inject_hourglass(of("hourglass", 2), p, step).unionByName(inject.inject_instability(of("instability", 1), p, step)).unionByName(inject.inject_frozen(of("frozen", 2), p))
    every = every.unionByName(inject.inject_penetration(plan.where("type = 'penetration'"), p, r, c, step)).unionByName(inject.inject_inversion(plan.where("type = 'inversion'"), centres, p, r, c))
    assert every.select("type").distinct().count() == 5
    assert every.join(r, "node").where("node_type <> 0").count() == 0
    assert every.groupBy("sim", "type", "sev", "frame", "node").count().where("count > 1").count() == 0


def test_severity_scales_the_hourglass(toy, copies):
    p, r, c = toy
    plan, centres = copies
    step = detect.step_scale(p, r)
    deltas = inject.inject_hourglass(inject.patch(plan.where("type = 'hourglass'"), centres, mesh.mesh_edges(c), r, 2), p, step)
    sizes = {(x.sim, x.sev): x.d for x in moved(p, deltas).groupBy("sim", "sev").agg(F.max("d").alias("d")).collect()}
    steps = {x.sim: x.step for x in step.collect()}
    for (sim, sev), d in sizes.items():
        assert d == pytest.approx(inject.SEVERITIES[sev] * steps[sim], rel=1e-9)
    patch = inject.patch(plan.where("type = 'instability'"), centres, mesh.mesh_edges(c), r, 1)
    peak = moved(p, inject.inject_instability(patch, p, step)).groupBy("sim", "sev").agg(F.max("d").alias("d")).collect()
    assert all(x.d == pytest.approx(inject.SEVERITIES[x.sev] * steps[x.sim], rel=1e-9) for x in peak)


def test_frozen_holds_and_inversion_flips(toy, copies):
    p, r, c = toy
    plan, centres = copies
    held = inject.inject_frozen(inject.patch(plan.where("type = 'frozen' and sev = 1"), centres, mesh.mesh_edges(c), r, 2), p)
    assert {x.n for x in held.groupBy("sim", "node").agg(F.count("*").alias("n")).collect()} == {2}
    assert held.groupBy("sim", "node").agg(F.countDistinct("x").alias("n")).where("n > 1").count() == 0
    flipped = inject.inject_inversion(plan.where("type = 'inversion' and sev = 3"), centres, p, r, c)
    copy = mesh.apply_deltas(p, flipped.select("sim", "frame", "node", "x", "y", "z"))
    assert detect.inverted_cells(p, r, c).count() == 0
    bad = detect.inverted_cells(copy, r, c).select("sim", "frame").distinct()
    assert bad.count() == flipped.select("sim", "frame").distinct().count()
    assert detect.jacobian_frame_scores(detect.jacobian_scores(copy, r, c), r).agg(F.max("score")).first()[0] >= 1


def test_blowup_reaches_its_cap(toy):
    p, r, c = toy
    step = detect.step_scale(p, r)
    plan = inject.plan_blowups(p.select("sim").distinct(), inject.acceleration_floor(p, r, 58), step, 200, cap=2.0, onset=10)
    for x in plan.collect():
        assert x.start * 1.3 ** (x.n_grow - 1) == pytest.approx(x.top) and 10 <= x.t0 and x.t0 + x.n_grow + 5 <= 200


@pytest.mark.parametrize("kind,same", [("scale", 0.0), ("lag", 0), ("timescale", 1.0)])
def test_identity_parameters(toy, kind, same):
    p, r, _ = toy
    assert mesh.deviation(p, inject.inject_global(p, r, kind, same)).agg(F.max("distance")).first()[0] < 1e-12
    with pytest.raises(ValueError):
        inject.inject_global(p, r, "twist", 1.0)


def test_rigid_motion_scores_zero(toy):
    p, r, c = toy
    rigid = p.select("sim", "frame", "node").join(r, "node").select("sim", "frame", "node", *[(F.col(f"r{k}") + F.col("frame") * 0.5).alias(k) for k in "xyz"])
    edges = mesh.mesh_edges(c)
    assert detect.velocity_laplacian_scores(rigid, edges).agg(F.max("score")).first()[0] < 1e-9
    assert detect.laplacian_scores(rigid, r, edges).agg(F.max("score")).first()[0] < 1e-9
    assert detect.constvel_scores(rigid).agg(F.max("score")).first()[0] < 1e-9
    still = rigid.withColumn("z", F.when(F.col("node") == 0, 0.0).otherwise(F.col("z")))
    assert detect.velocity_laplacian_scores(still, edges).agg(F.max("score")).first()[0] > 1e-6
    levels = detect.calibrated(detect.constvel_scores(rigid), r, (5, 15, 25))
    assert levels.where("score is null or isnan(score)").count() == 0


def closest(p, a, b, c):
    """Distance of a point to a triangle, by a fine search over it."""
    u, v = np.meshgrid(np.linspace(0, 1, 201), np.linspace(0, 1, 201))
    keep = u + v <= 1
    q = a + u[keep][:, None] * (b - a) + v[keep][:, None] * (c - a)
    return np.linalg.norm(q - p, axis=1).min()


def test_point_triangle_distance(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(40, 4, 3))
    names = [f"{n}{c}" for n in "pabc" for c in "xyz"]
    df = spark.createDataFrame([tuple(map(float, x.ravel())) for x in pts], names)
    got = mesh.closest_on_triangles(df, "p", "a", "b", "c").select("near.d", "px").collect()
    want = {float(x[0, 0]): closest(*x) for x in pts}
    assert all(abs(r.d - want[r.px]) < 0.02 for r in got)


def test_signed_distance_sign(toy):
    p, r, c = toy
    inside = p.where("sim = 1 and frame < 3")
    centre = inside.where("node >= 5").groupBy("sim", "frame").agg(*[F.avg(k).alias("m" + k) for k in "xyz"])
    sunk = inside.join(centre, ["sim", "frame"]).select("sim", "frame", "node", *[F.when(F.col("node") == 0, F.col("m" + k)).otherwise(F.col(k)).alias(k) for k in "xyz"])
    depth = {x.node: x.d for x in detect.contact_scores(sunk, r, c).groupBy("node").agg(F.min("score").alias("d")).collect()}
    assert depth[0] > 0 and all(d == 0 for n, d in depth.items() if n > 0)


def test_no_interval_below_twenty_clusters(spark):
    rows = [(s, "t", bool(k % 2), float(k + s)) for s in range(5) for k in range(4)]
    ci = resample.bootstrap_ci(spark.createDataFrame(rows, "sim int, type string, label boolean, score double"), ["type"], 20).first()
    assert ci.clusters == 5 and ci.lo is None and ci.hi is None


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("b", True, 1.0), ("b", False, 1.0)], "k string, label boolean, score double")
    assert {r.k: r.auroc for r in metrics.auroc(df, ["k"]).collect()} == {"a": None, "b": 0.5}


def test_lead_times_and_censoring(spark):
    scores = spark.createDataFrame([(1, f, "d", 9.0 if f >= 115 else 0.0) for f in range(90, 128)] + [(2, f, "d", 0.0) for f in range(90, 128)], "sim int, frame int, detector string, score double")
    events = spark.createDataFrame([(1, "blowup", 100, 127), (2, "frozen", 100, 110)], "sim int, kind string, t0 int, end int")
    got = {r.sim: (r.first, r.lead) for r in alarms.lead_times(scores, events, spark.createDataFrame([("d", 1.0)], "detector string, threshold double")).collect()}
    assert got == {1: (115, 12), 2: (None, None)}


def test_alarms_after_the_end_do_not_count(spark):
    scores = spark.createDataFrame([(s, f, "d", 9.0 if f == late else 2.0 if f == 87 else 0.0) for s, late in ((1, 120), (2, 105)) for f in range(80, 130)], "sim int, frame int, detector string, score double")
    events = spark.createDataFrame([(s, "frozen", 100, 110, 85) for s in (1, 2)], "sim int, kind string, t0 int, end int, start int")
    thresholds = spark.createDataFrame([("d", 1.0)], "detector string, threshold double")
    assert {r.sim: r.lead for r in alarms.lead_times(scores, events, thresholds).collect()} == {1: None, 2: 5}
    r = alarms.lead_summary(scores, events, thresholds, 20).first()
    assert (r.n, r.detected, r.median_lead, r.lo, r.hi) == (2, 0.5, 5, 5, 5) and r.false_alarm_rate == pytest.approx(1 / 12)  # frames 85 to 96


def test_event_bounds_and_scored_window(spark):
    rows = [(1, "blowup", f, 0.0 if f < 20 else float(min(f - 19, 5))) for f in range(40)] + [(2, "frozen", f, float(10 <= f < 15)) for f in range(40)]
    got = {r.sim: (r.t0, r.end, r.start) for r in alarms.event_bounds(spark.createDataFrame(rows, "sim int, kind string, frame int, deviation double")).collect()}
    assert got == {1: (20, 24, 5), 2: (10, 14, 2)}


def test_weighted_auroc_counts_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), "ab"[k % 2], bool(rng.random() < 0.5), float(rng.integers(0, 6))) for s in range(8) for k in range(9)]
    df = spark.createDataFrame(rows, "sim int, type string, label boolean, score double").repartition(5)
    weights = resample.bootstrap_weights(df, 7)
    w = {(r.rep, r.sim): r.weight for r in weights.collect()}
    got = {(r.type, r.rep): r.auroc for r in resample.weighted_auroc(df, weights, ["type"], 7).collect()}
    for t in "ab":
        for rep in range(7):
            own = [(y, x, w.get((rep, s), 0)) for s, k, y, x in rows if k == t]
            pairs = [(a * b, (x > z) + (x == z) / 2) for y, x, a in own if y for v, z, b in own if not v]
            total = sum(a for a, _ in pairs)
            assert got.get((t, rep)) == (pytest.approx(sum(a * b for a, b in pairs) / total) if total else None)


def test_gate_needs_a_better_surrogate(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(40):
        for kind, shift in (("clean", 0.0), ("scale", 3.0)):
            rows += [(s, kind, 0.1, "good", float(rng.normal() + shift)), (s, kind, 0.1, "bad", float(rng.normal())), (s, kind, 0.1, "rule", float(rng.normal() + shift / 6))]
    got = {r.stat: r for r in alarms.gate_runs(spark.createDataFrame(rows, "sim int, kind string, parameter double, detector string, z double"), ("good", "bad"), ("rule",), 100).collect()}
    assert got["good"].better and got["good"].passed and got["good"].lo > 0 and got["good"].rule == "rule"
    assert not got["bad"].better and got["bad"].delta < 0.2


def test_penetration_goes_in_and_inversion_moves_the_centre(toy, copies):
    p, r, c = toy
    plan, centres = copies
    centre = p.where("node >= 5").groupBy("sim", "frame").agg(*[F.avg(k).alias("m" + k) for k in "xyz"])  # node 0 is put inside the actuator
    lifted = p.join(centre, ["sim", "frame"]).select("sim", "frame", "node", *[F.when(F.col("node") == 0, F.col("m" + k)).otherwise(F.col(k)).alias(k) for k in "xyz"]).cache()
    own = plan.where("type = 'penetration' and sev = 1")
    deltas = inject.inject_penetration(own, lifted, r, c, detect.step_scale(lifted, r).withColumn("step", F.lit(0.5)))
    assert mesh.signed_distance(lifted, r, c).where("node = 0").agg(F.max("distance")).first()[0] < 0
    after = mesh.signed_distance(mesh.apply_deltas(lifted, deltas.select("sim", "frame", "node", "x", "y", "z")), r, c)
    depth = after.join(deltas.select("sim", "frame", "node"), ["sim", "frame", "node"])
    assert depth.count() and depth.where("abs(distance + 0.5) > 0.1").count() == 0  # as deep as the size, wherever it was before
    turned = inject.inject_inversion(plan.where("type = 'inversion'"), centres, p, r, c).select("sim", "type", "sev", "node").distinct()
    assert turned.join(centres, ["sim", "type", "sev", "node"]).count() == turned.count() > 0


def test_penetration_starts_at_contact(spark):
    plan = spark.createDataFrame([(1, "penetration", 1, 5, 0), (2, "penetration", 1, 6, 0)], "sim int, type string, sev int, seed int, t0 int")
    gaps = spark.createDataFrame([(1, f, 0.001 if f in (50, 60) else 1.0) for f in range(100)] + [(2, f, 1.0 + abs(f - 70)) for f in range(100)], "sim int, frame int, gap double")
    got = {x.sim: x.t0 for x in inject.contact_onsets(plan, gaps, (40, 90)).collect()}
    assert got[1] in (50, 60) and got[2] == 70


def test_tau_and_multiclass_measures(spark):
    df = spark.createDataFrame([(i, c / 10, int(c > 4)) for i, c in enumerate(range(10))], "item int, conf double, correct int")
    assert metrics.fit_tau(df, 1.0) == 0.5 and metrics.abstain_rate(df, 0.5).first()[0] == 0.5
    rows = spark.createDataFrame([("a", "a", [0.8, 0.2], 0), ("b", "a", [0.6, 0.4], 1)], "truth string, pred string, probs array<double>, truth_index int")
    assert metrics.brier_multiclass(rows).first()[0] == pytest.approx((0.04 + 0.04 + 0.36 + 0.36) / 2)
    assert metrics.macro_f1(rows, ["a", "b"]).first()[0] == pytest.approx((2 / 3 + 0) / 2)


def test_conformal_guarantee(spark):
    draws = np.random.default_rng(0).gumbel(size=(400, 31))
    rows = [(i, str(t), float(x)) for t, row in enumerate(draws) for i, x in enumerate(row[:30])]
    got = {int(r.detector): r.threshold for r in alarms.conformal_threshold(spark.createDataFrame(rows, "sim int, detector string, run_max double"), 0.1).collect()}
    assert np.mean([draws[t, 30] > got[t] for t in got]) <= 0.14
    few = spark.createDataFrame([(i, "d", float(i)) for i in range(10)], "sim int, detector string, run_max double")
    assert alarms.conformal_threshold(few, 0.01).first().threshold == float("inf")


def test_triage_on_separable_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(s, f, 1, k, k != "none", d, float(np.exp(i + 1) * (1 if d == "a" else 7 - i) + rng.random())) for s in range(30) for f in range(4) for i, k in enumerate(("none", "x", "y")) for d in ("a", "b")]
    rows = [(s, f * 3 + ("none", "x", "y").index(k), v, k, lab, d, sc) for s, f, v, k, lab, d, sc in rows]
    features = answers.triage_features(spark.createDataFrame(rows, "sim int, frame int, sev int, type string, label boolean, detector string, score double"), ["a", "b"])
    model = answers.fit_triage(features.where("sim < 15"), ["a", "b"], 10, 5)
    out = answers.predict_triage(model, features.where("sim >= 15"))
    assert out.agg(F.avg((F.col("pred") == F.col("kind")).cast("double"))).first()[0] > 0.9
    with pytest.raises(ValueError):
        answers.fit_triage(features, ["a", "node_stress"])


def test_temperature_undoes_sharpening(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        p = rng.dirichlet([1, 1, 1])
        sharp = p**3 / (p**3).sum()
        rows.append((sharp.tolist(), int(rng.choice(3, p=p))))
    t = answers.fit_temperature(spark.createDataFrame(rows, "probs array<double>, truth_index int"))
    assert 2.3 < t < 3.8


def test_columns(spark):
    df = spark.createDataFrame([(None,), ("The Tion",)], "t string")
    assert [r[0] for r in df.select(terms(F.col("t"), ["the", "tion", "x"])).collect()] == [[], ["the", "tion"]]
    one = spark.range(1).select(jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), softmax(F.array(F.lit(0.0), F.lit(1000.0))).alias("s")).first()
    assert one.j == 1.0 and one.s[1] == 1.0 and one.s[0] == 1e-12


def test_answers_with_broken_json(spark):
    df = spark.createDataFrame([('x {"anomaly_type": "a", "location": "c1"} y',), ('{"anomaly_type": "a"',), ('{"anomaly_type": "z"}',), (None,), ("no braces",)], "raw string")
    assert [r[0] for r in df.select(answers.parse_answer(F.col("raw"), ["a"])["location"]).collect()] == ["c1", None, None, None, None]


# --- sources


def field(number, payload):
    n, out = len(payload), bytes([number << 3 | 2])
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + payload


def record(features):
    entries = b"".join(field(1, field(1, k.encode()) + field(2, field(1, field(1, v)))) for k, v in features.items())
    message = field(1, entries)
    return struct.pack("<Q", len(message)) + b"0000" + message + b"0000"


def test_tensor_records_round_trip(spark, tmp_path):
    t, n = 5, 3
    rng = np.random.default_rng(0)
    world, rest, kind = rng.normal(size=(t, n, 3)).astype("f4"), rng.normal(size=(1, n, 3)).astype("f4"), np.array([[[0], [1], [3]]], "i4")
    raw = record({"world_pos": world.tobytes(), "mesh_pos": rest.tobytes(), "node_type": kind.tobytes(), "stress": b"1234"})
    (tmp_path / "a.rec").write_bytes(raw + raw)
    meta = {"world_pos": {"dtype": "f4", "shape": (t, n, 3)}, "mesh_pos": {"dtype": "f4", "shape": (1, n, 3)}, "node_type": {"dtype": "i4", "shape": (1, n, 1)}, "stress": {"dtype": "f4", "shape": (1,)}}
    df = tables.ingest_tensors(spark, str(tmp_path), meta)
    assert df.count() == 2 * t * n and not [c for c in df.columns if "stress" in c]
    got = {(r.frame, r.node): (r.x, r.y, r.z, r.node_type) for r in df.where("sim = 0").collect()}
    assert all(got[f, k] == pytest.approx((*world[f, k], kind[0, k, 0])) for f in range(t) for k in range(n))
    assert tables.ingest_tensors(spark, str(tmp_path), meta, limit=1).count() == t * n


def test_metrics_files_and_guards(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# split=valid\ntype,sev,phase,detector,auroc,lo,hi,tpr\nfrozen,1,all,a,0.5,,,0.1\n")
    df = tables.read_metrics(spark, str(tmp_path / "m.csv"))
    assert df.count() == 1 and df.first().auroc == 0.5 and df.first().lo is None
    tables.write_metrics(df, str(tmp_path / "out"))
    assert tables.read_metrics(spark, str(tmp_path / "out")).count() == 1
    tables.write_thresholds(df.select("detector", "auroc"), str(tmp_path / "thr" / "valid"))
    assert tables.read_thresholds(spark, str(tmp_path / "thr" / "valid")).count() == 1
    marked = tables.with_provenance(df, {"split": "valid"})
    tables.assert_meta(marked, split="valid")
    with pytest.raises(ValueError):
        tables.assert_meta(marked, split="test")
    spark.range(10).withColumnRenamed("id", "sim").write.parquet(str(tmp_path / "runs" / "valid"))
    assert tables.load_split(spark, str(tmp_path / "runs"), "valid", 2, 5).count() == 3
    a = spark.createDataFrame([(1, "t", 1, 1, True)], "sim int, type string, sev int, frame int, label boolean")
    metrics.assert_labels_agree(a, a)
    with pytest.raises(ValueError):
        metrics.assert_labels_agree(a, a.withColumn("label", ~F.col("label")))


def test_runs_are_whole(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    got = {r["sim"]: r for r in view(spark, SF, "positions").groupBy("sim").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last")).collect()}
    assert {r["l_suppkey"]: (r["count"] // 9 * 9, r["count"] // 9 - 1) for r in rows} == {k: (v["n"], v["last"]) for k, v in got.items()}
    assert max(v["last"] for v in got.values()) > 57


def test_replicates_let_holm_reject():
    from trajscreen.plans import evaluation

    types = 5
    assert 1 / (evaluation.GATE_REPS + 1) < 0.05 / types and 0.025 * evaluation.REPS > 10
    assert evaluation.PERMUTATIONS == evaluation.MEDIAN_REPS == 1000
    assert all(f"range({n})" in evaluation.ORACLE_SQL[q] for q, n in (("b1_bootstrap_ci", 500), ("b5_holm", 2000), ("b6_run_auroc", 2000), ("b7_median_ci", 1000), ("b8_permutation_p", 1000)))


def test_answers_hold_whole_texts(spark):
    texts = spark.read.parquet(f"{SF}/conversations.parquet").agg(F.sum(F.length("text")).alias("n")).first()["n"]
    a = view(spark, SF, "answers").where("length(raw) > 0")
    assert a.agg(F.sum(F.locate(' {"anomaly_type"', F.col("raw")) - 1).alias("n")).first()["n"] == texts


def test_spread_table(spark):
    clean = [(s, "a", float(v)) for s, v in enumerate((1, 2, 3, 6))] + [(s, "zero", 0.0) for s in range(4)]
    moved = [(s, d, v + s) for s, d, v in clean]
    schema = "sim int, detector string, value double"
    got = {r.detector: r for r in alarms.spread_table(spark.createDataFrame(clean, schema), spark.createDataFrame(moved, schema)).collect()}
    assert abs(got["a"].clean_cv - 3.5**0.5 / 3) < 1e-9
    assert abs(got["a"].median_shift - 1.5 / 1.4826) < 1e-9
    assert got["zero"].clean_cv == 0
