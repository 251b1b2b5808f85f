"""Registered queries over trajectories: geometry, mesh, injection, detectors, calibration, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajscreen.functions.columns import norm3
from trajscreen.operators import alarms, detect, inject, mesh, metrics, runs
from trajscreen.plans.fixtures import oracle, view

CALIB = range(5, 2**31 - 1, 10)  # every tenth frame of a run, however long
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None, zero: tuple[str, ...], queries: dict[str, Query], oracles: dict[str, str]) -> Callable[[Query], Query]:
    """Put a query and its SQL into the dictionaries. zero: columns in which a negative zero becomes zero, on both sides."""

    def add(f: Query) -> Query:
        queries[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c) + F.lit(0.0) for c in zero})) if zero else f
        if sql:
            oracles[name] = "SELECT * REPLACE (" + ", ".join(f"{c} + 0e0 AS {c}" for c in zero) + f") FROM ({sql}) z" if zero else sql
        return f

    return add


def query(name: str, sql: str | None = None, zero: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    return registered(name, sql, zero, QUERIES, ORACLE_SQL)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def by_run(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """job(positions, rest, cells), all of whose steps are by run, on about most rows of runs at once."""
    p, r, c = _views(spark, sf_dir, "positions", "rest", "cells")
    return runs.by_run(p, lambda held: job(held, r, c), view(spark, sf_dir, "lineitem").count(), most)


# building blocks of the oracle SQL
STEPS = """, sp AS (SELECT *, x - lag(x) OVER t AS vx, y - lag(y) OVER t AS vy, z - lag(z) OVER t AS vz FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)),
speed AS (SELECT sim, frame, node, vx, vy, vz, sqrt(vx*vx + vy*vy + vz*vz) AS speed FROM sp WHERE vx IS NOT NULL)"""
CONSTVEL = """, cv AS (SELECT sim, frame, node, sqrt(dx*dx + dy*dy + dz*dz) AS score FROM (SELECT sim, frame, node,
  x - (2*lag(x, 1) OVER t - lag(x, 2) OVER t) AS dx, y - (2*lag(y, 1) OVER t - lag(y, 2) OVER t) AS dy, z - (2*lag(z, 1) OVER t - lag(z, 2) OVER t) AS dz FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)) q WHERE dx IS NOT NULL)"""
DISP = ", disp AS (SELECT sim, frame, p.node, node_type, x - rx AS ux, y - ry AS uy, z - rz AS uz FROM positions p JOIN rest ON p.node = rest.node)"
VOLUME = "((({b}y-{a}y)*({c}z-{a}z)-({b}z-{a}z)*({c}y-{a}y))*({d}x-{a}x)+(({b}z-{a}z)*({c}x-{a}x)-({b}x-{a}x)*({c}z-{a}z))*({d}y-{a}y)+(({b}x-{a}x)*({c}y-{a}y)-({b}y-{a}y)*({c}x-{a}x))*({d}z-{a}z))/6"
VOL = f""", vol AS (SELECT p0.sim, p0.frame, cell, {VOLUME.format(a='p0.', b='p1.', c='p2.', d='p3.')} AS volume FROM cells JOIN positions p0 ON p0.node = v0 JOIN positions p1 ON p1.node = v1 AND p1.sim = p0.sim AND p1.frame = p0.frame
  JOIN positions p2 ON p2.node = v2 AND p2.sim = p0.sim AND p2.frame = p0.frame JOIN positions p3 ON p3.node = v3 AND p3.sim = p0.sim AND p3.frame = p0.frame)"""
RESTVOL = f", rv AS (SELECT cell, {VOLUME.format(a='p0.r', b='p1.r', c='p2.r', d='p3.r')} AS rest_volume FROM cells JOIN rest p0 ON p0.node = v0 JOIN rest p1 ON p1.node = v1 JOIN rest p2 ON p2.node = v2 JOIN rest p3 ON p3.node = v3)"
FRAME = "(SELECT sim, frame, avg(score) AS score FROM (SELECT s.sim, s.frame, s.score, row_number() OVER (PARTITION BY s.sim, s.frame ORDER BY s.score DESC, s.node) AS r FROM {0} s JOIN rest ON s.node = rest.node WHERE node_type = 0) q WHERE r <= 5 GROUP BY sim, frame)"


@query("p1_displacement", oracle(DISP + " SELECT sim, frame, node, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz FROM disp", "positions"), zero=('ux', 'uy', 'uz'))
def p1(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(mesh.displacement(p, r).select("sim", "frame", "node", "ux", "uy", "uz"), "ux", "uy", "uz")


@query("p4_one_hot_nodes", oracle("SELECT sim, rest.node, CAST(node_type = 0 AS DOUBLE) AS type_0, CAST(node_type = 1 AS DOUBLE) AS type_1, CAST(node_type = 2 AS DOUBLE) AS type_2, CAST(node_type = 3 AS DOUBLE) AS type_3 FROM rest, (SELECT DISTINCT sim FROM positions)", "positions"))
def p4(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return mesh.one_hot(p.select("sim", "node").distinct().join(r, "node")).select("sim", "node", "type_0", "type_1", "type_2", "type_3")


@query("p5_tet_volumes", oracle(VOL + " SELECT sim, frame, cell, round(volume, 4) AS volume FROM vol", "positions", "cells"), zero=('volume',))
def p5(spark, d):
    p, c = _views(spark, d, "positions", "cells")
    return rounded(mesh.tet_volumes(c, p, ("sim", "frame")), "volume", digits=4)


MATRIX = ((2e-2, 0.0, 5e-3, -2e-1), (0.0, 2e-2, 4e-3, -1e-1), (0.0, 0.0, 1e-2, 0.0), (1e-3, 2e-3, 1e-3, 1.0))
PX = "(({m[0][0]}*x+{m[0][1]}*y+{m[0][2]}*z+{m[0][3]})/({m[3][0]}*x+{m[3][1]}*y+{m[3][2]}*z+{m[3][3]})+1)/2*448e0"
PY = "(1-({m[1][0]}*x+{m[1][1]}*y+{m[1][2]}*z+{m[1][3]})/({m[3][0]}*x+{m[3][1]}*y+{m[3][2]}*z+{m[3][3]}))/2*448e0"
_E = tuple(tuple(f"{v:e}" for v in r) for r in MATRIX)


@query("p6_project", oracle(f"SELECT sim, frame, node, round({PX.format(m=_E)}, 5) AS px, round({PY.format(m=_E)}, 5) AS py FROM positions", "positions"))
def p6(spark, d):
    return rounded(mesh.project(view(spark, d, "positions"), MATRIX).select("sim", "frame", "node", "px", "py"), "px", "py", digits=5)


@query("p7_grid_cell", oracle(f"SELECT sim, frame, CAST(least(greatest(floor(avg(py)*3/448e0), 0), 2) AS INT) AS \"row\", CAST(least(greatest(floor(avg(px)*3/448e0), 0), 2) AS INT) AS col FROM (SELECT sim, frame, {PX.format(m=_E)} AS px, {PY.format(m=_E)} AS py FROM positions) q GROUP BY sim, frame", "positions"))
def p7(spark, d):
    return mesh.grid_cell(mesh.project(view(spark, d, "positions"), MATRIX), ("sim", "frame"))


@query("p9_crop_box", oracle(f"""SELECT sim, round((a+b)/2 - greatest(b-a, e-c)/2*1.08e0 - 4, 5) AS "left", round((c+e)/2 - greatest(b-a, e-c)/2*1.08e0 - 4, 5) AS top, round(greatest(b-a, e-c)*1.08e0 + 8, 5) AS side FROM (
  SELECT sim, min(px) AS a, max(px) AS b, min(py) AS c, max(py) AS e FROM (SELECT sim, {PX.format(m=_E)} AS px, {PY.format(m=_E)} AS py FROM (SELECT *, max(frame) OVER (PARTITION BY sim) AS last FROM positions) p WHERE (frame = 0 OR frame = last) AND node <= 4) q GROUP BY sim) w""", "positions"))
def p9(spark, d):
    p = view(spark, d, "positions")
    px = mesh.project(p.join(mesh.run_lengths(p), "sim").where("(frame = 0 or frame = t_max - 1) and node <= 4"), MATRIX)
    return rounded(mesh.crop_box(px), "left", "top", "side", digits=5)


@query("p14_step_node_features", oracle("""SELECT sim, frame, node, round(x - lag(x) OVER t, 6) AS vx, round(y - lag(y) OVER t, 6) AS vy, round(z - lag(z) OVER t, 6) AS vz,
  CASE WHEN node_type = 1 THEN round(lead(x) OVER t - x, 6) ELSE 0e0 END AS ax, CASE WHEN node_type = 1 THEN round(lead(y) OVER t - y, 6) ELSE 0e0 END AS ay, CASE WHEN node_type = 1 THEN round(lead(z) OVER t - z, 6) ELSE 0e0 END AS az
FROM (SELECT p.*, node_type FROM positions p JOIN rest ON p.node = rest.node) q WINDOW t AS (PARTITION BY sim, node ORDER BY frame)""", "positions"), zero=('vx', 'vy', 'vz', 'ax', 'ay', 'az'))
def p14(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    at = p.join(r.select("node", "node_type"), "node")
    v = [F.round(F.col(c) - F.lag(c).over(detect.track()), 6).alias(f"v{c}") for c in "xyz"]
    a = [F.when(F.col("node_type") == 1, F.round(F.lead(c).over(detect.track()) - F.col(c), 6)).otherwise(0.0).alias(f"a{c}") for c in "xyz"]
    return at.select("sim", "frame", "node", *v, *a)


def _offsets(left: str, right: str, out: str, rest: str = "") -> str:
    """Offset columns and length: SQL."""
    d = [f"({left}.{rest}{c}-{right}.{rest}{c})" for c in "xyz"]
    return ", ".join(f"round({k}, 6) AS {out}{c}" for k, c in zip(d, "xyz", strict=True)) + f", round(sqrt({'+'.join(k + '*' + k for k in d)}), 6) AS {out}length"


NOW, RESTED = ("now_x", "now_y", "now_z"), ("rest_x", "rest_y", "rest_z")


@query("p15_step_edge_features", oracle(f"""SELECT p.sim, p.frame, src, dst, {_offsets('a', 'b', 'rest_', 'r')}, {_offsets('p', 'q', 'now_')}
FROM edges JOIN rest a ON a.node = src JOIN rest b ON b.node = dst JOIN positions p ON p.node = src JOIN positions q ON q.node = dst AND q.sim = p.sim AND q.frame = p.frame""", "positions", "edges"), zero=(*NOW, *RESTED))
def p15(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    return rounded(mesh.step_edge_features(p, r, mesh.mesh_edges(c)), *RESTED, "rest_length", *NOW, "now_length")


@query("p15_contact_edge_features", oracle(f"""SELECT p.sim, p.frame, p.node AS src, q.node AS dst, {_offsets('p', 'q', 'now_')} FROM positions p JOIN positions q ON q.sim = p.sim AND q.frame = p.frame JOIN rest a ON a.node = p.node JOIN rest b ON b.node = q.node
WHERE ((a.node_type = 0 AND b.node_type = 1) OR (a.node_type = 1 AND b.node_type = 0)) AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) <= 215e-1""", "positions"), zero=NOW)
def p15b(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(mesh.contact_edge_features(p, r, 21.5), *NOW, "now_length")


LOADED = [f"{k}{c}" for k in ("own_u", "mean_u", "off_") for c in "xyz"]


@query("p16_load_features", oracle(DISP + """, ct AS (SELECT avg(rx) AS cx, avg(ry) AS cy, avg(rz) AS cz FROM rest WHERE node_type = 1) SELECT d.sim, d.frame, d.node, """ + ", ".join(f"CASE WHEN d.node_type = 1 THEN round(u{c}, 6) ELSE 0e0 END AS own_u{c}, round(m.m{c}, 6) AS mean_u{c}, r.r{c}, round(r.r{c} - ct.c{c}, 6) AS off_{c}" for c in "xyz") + ", " + ", ".join(f"CASE WHEN r.node_type = {k} THEN 1e0 ELSE 0e0 END AS type_{k}" for k in range(4)) + """
FROM ct, disp d JOIN rest r ON r.node = d.node JOIN (SELECT sim, frame, avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz FROM disp WHERE node_type = 1 GROUP BY sim, frame) m ON d.sim = m.sim AND d.frame = m.frame""", "positions"), zero=tuple(LOADED))
def p16(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(mesh.load_features(p, r), *LOADED)


NOISE = "(CASE WHEN node_type = 0 THEN 5e-2 * sqrt(-2 * ln((('0x' || substr(md5('3|' || sim || '|' || frame || '|' || node || '|{c}u'), 1, 8))::BIGINT + 1) / 4294967296e0)) * cos(2 * pi() * ((('0x' || substr(md5('3|' || sim || '|' || frame || '|' || node || '|{c}v'), 1, 8))::BIGINT + 1) / 4294967296e0)) ELSE 0 END)"


@query("p18_training_pairs", oracle("SELECT sim, frame, node, " + ", ".join(f"round(t{c}, 6) AS t{c}" for c in "xyz") + " FROM (SELECT sim, frame, node, " + ", ".join(f"lead({c}) OVER t - 2*({c} + {NOISE.format(c=c)}) + lag({c}) OVER t AS t{c}" for c in "xyz") + " FROM (SELECT p.*, node_type FROM positions p JOIN rest ON p.node = rest.node) k WINDOW t AS (PARTITION BY sim, node ORDER BY frame)) q WHERE tx IS NOT NULL AND frame >= 1 AND frame < 50", "positions"), zero=("tx", "ty", "tz"))
def p18(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(mesh.training_pairs(p, r, 0.05, 3, 50), "tx", "ty", "tz")


@query("j1_mesh_edges", oracle("SELECT sim, src, dst FROM edges, (SELECT DISTINCT sim FROM positions)", "positions", "edges"))
def j1(spark, d):
    p, c = _views(spark, d, "positions", "cells")
    per_sim = p.join(c.select(*c.columns, F.col("v0").alias("node")), "node").select("sim", *c.columns).distinct()
    return mesh.mesh_edges(per_sim, ("sim",))


@query("j2_world_edges", oracle("""SELECT a.sim, a.frame, a.node AS src, b.node AS dst, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS distance FROM positions a JOIN positions b ON a.sim = b.sim AND a.frame = b.frame JOIN rest r ON r.node = a.node JOIN rest q ON q.node = b.node
WHERE ((r.node_type = 1 AND q.node_type = 0) OR (r.node_type = 0 AND q.node_type = 1)) AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 215e-1""", "positions"))
def j2(spark, d):
    return rounded(by_run(spark, d, lambda p, r, c: mesh.world_edges(p, r, 21.5)), "distance")


@query("j4_neighbour_mean", oracle(DISP + ", m AS (SELECT d.sim, d.frame, dst AS node, avg(uz) AS m FROM disp d JOIN edges ON d.node = src GROUP BY d.sim, d.frame, dst) SELECT d.sim, d.frame, d.node, round(uz, 6) AS uz, round(coalesce(m, 0), 6) AS mean_uz FROM disp d LEFT JOIN m ON d.sim = m.sim AND d.frame = m.frame AND d.node = m.node", "positions", "edges"), zero=('uz', 'mean_uz'))
def j4(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    u = mesh.displacement(p, r).select("sim", "frame", "node", "uz")
    return rounded(mesh.neighbour_mean(u, mesh.mesh_edges(c), ["uz"], ("sim", "frame")), "uz", "mean_uz")


@query("j5_hops", oracle("""SELECT sim, node, min(depth) AS depth FROM (SELECT sim, c AS node, 0 AS depth FROM centre UNION ALL SELECT sim, dst, 1 FROM centre JOIN edges ON src = c JOIN rest ON rest.node = dst WHERE node_type = 0
  UNION ALL SELECT sim, e2.dst, 2 FROM centre JOIN edges e1 ON e1.src = c JOIN rest r1 ON r1.node = e1.dst AND r1.node_type = 0 JOIN edges e2 ON e2.src = e1.dst JOIN rest r2 ON r2.node = e2.dst AND r2.node_type = 0) q GROUP BY sim, node""".join([", centre AS (SELECT DISTINCT sim, CAST(sim % 5 AS INT) AS c FROM positions) ", ""]), "positions", "edges"))
def j5(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    centres = p.select("sim", F.expr("cast(sim % 5 as int)").alias("node")).distinct()
    return mesh.hops(centres, mesh.mesh_edges(c), mesh.plate(r).select("node"), 2, ("sim",))


GAP = ", gaps AS (SELECT a.sim, a.frame, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS gap FROM positions a JOIN positions b ON a.sim = b.sim AND a.frame = b.frame WHERE a.node <= 4 AND b.node >= 5 GROUP BY a.sim, a.frame)"


@query("j6_min_gap", oracle(GAP + " SELECT sim, frame, round(gap, 6) AS gap FROM gaps", "positions"))
def j6(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(mesh.min_gap(p, r), "gap")


@query("j6_contact_frames", oracle(GAP + ", m AS (SELECT *, min(gap) OVER (PARTITION BY sim) AS least, row_number() OVER (PARTITION BY sim ORDER BY gap, frame) AS r FROM gaps) SELECT sim, frame FROM m WHERE gap < 39e-2 OR (least >= 39e-2 AND r = 1)", "positions"))
def j6b(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return mesh.contact_frames(mesh.min_gap(p, r), 0.39)


@query("j7_surface_triangles", oracle("""SELECT sim, a, b, c FROM (SELECT list_sort(f)[1] AS a, list_sort(f)[2] AS b, list_sort(f)[3] AS c FROM (SELECT unnest([[v1,v2,v3],[v0,v2,v3],[v0,v1,v3],[v0,v1,v2]]) AS f FROM cells WHERE v0 >= 5 AND v1 >= 5 AND v2 >= 5 AND v3 >= 5) q GROUP BY ALL HAVING count(*) = 1) t, (SELECT DISTINCT sim FROM positions)""", "positions", "cells"))
def j7(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    sims = p.select("sim", "node").distinct()
    per_sim = c.select(*c.columns, F.col("v0").alias("node")).join(sims, "node").select("sim", *c.columns)
    return mesh.surface_triangles(per_sim, sims.join(r, "node"), keys=("sim",))


DELTA = ", delta AS (SELECT sim, frame, node, x + 1e0 AS x, y, z - 5e-1 AS z FROM positions WHERE (sim*7 + frame*3 + node) % 11 = 0 AND node <= 4)"
COPY = DELTA + ", cp AS (SELECT p.sim, p.frame, p.node, coalesce(d.x, p.x) AS x, coalesce(d.y, p.y) AS y, coalesce(d.z, p.z) AS z FROM positions p LEFT JOIN delta d ON p.sim = d.sim AND p.frame = d.frame AND p.node = d.node)"


def changed(p: DataFrame) -> DataFrame:
    return p.where("(sim*7 + frame*3 + node) % 11 = 0 and node <= 4").select("sim", "frame", "node", (F.col("x") + 1.0).alias("x"), "y", (F.col("z") - 0.5).alias("z"))


@query("j9_apply_deltas", oracle(COPY + " SELECT sim, frame, node, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM cp", "positions"), zero=('x', 'y', 'z'))
def j9(spark, d):
    p = view(spark, d, "positions")
    return rounded(mesh.apply_deltas(p, changed(p)), "x", "y", "z")


@query("p19_deviation", oracle(COPY + " SELECT c.sim, c.frame, round(max(sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z))), 6) AS deviation FROM cp c JOIN positions p ON p.sim = c.sim AND p.frame = c.frame AND p.node = c.node GROUP BY c.sim, c.frame", "positions"))
def p19(spark, d):
    p = view(spark, d, "positions")
    return rounded(mesh.deviation(p, mesh.apply_deltas(p, changed(p))).groupBy("sim", "frame").agg(F.max("distance").alias("deviation")), "deviation")


@query("i9_label_frames", oracle(DELTA + " SELECT DISTINCT sim, frame FROM delta", "positions"))
def i9(spark, d):
    p = view(spark, d, "positions")
    return inject.label_frames(mesh.deviation(p, mesh.apply_deltas(p, changed(p))), ("sim",))


DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
TYPE_ROWS = "(VALUES ('hourglass', 0), ('penetration', 1), ('inversion', 2), ('instability', 3), ('frozen', 4)) AS t(type, i)"


@query("i0_plan_copies", oracle(f"SELECT sim, type, sev, seed, CAST(10 + {DRAW.format('CAST(seed AS VARCHAR) || chr(124) || chr(116) || chr(48)')} % 30 AS INT) AS t0 FROM (SELECT sim, type, sev, sim*100 + i*10 + sev AS seed FROM (SELECT DISTINCT sim FROM positions), {TYPE_ROWS}, (VALUES (1), (2), (3)) AS s(sev)) q", "positions"))
def i0(spark, d):
    return inject.plan_copies(view(spark, d, "positions").select("sim").distinct(), onset=(10, 40))


def _global_oracle(kind: str, v: float) -> str:
    if kind == "scale":
        body = ", ".join(f"round(CASE WHEN node_type = 0 THEN r{c} + {1 + v:e} * ({c} - r{c}) ELSE {c} END, 6) AS {c}" for c in "xyz")
        return oracle(f"SELECT sim, frame, p.node, {body} FROM positions p JOIN rest ON p.node = rest.node", "positions")
    if kind == "lag":
        body = ", ".join(f"round(CASE WHEN node_type = 0 THEN q.{c} ELSE p.{c} END, 6) AS {c}" for c in "xyz")
        return oracle(f"SELECT p.sim, p.frame, p.node, {body} FROM positions p JOIN rest ON p.node = rest.node JOIN positions q ON q.sim = p.sim AND q.node = p.node AND q.frame = greatest(p.frame - {int(v)}, 0)", "positions")
    body = ", ".join(f"round(CASE WHEN node_type = 0 THEN r{c} + (1-w)*(a.{c}-r{c}) + w*(b.{c}-r{c}) ELSE p.{c} END, 6) AS {c}" for c in "xyz")
    t = f"p.frame*{v:e}"
    return oracle(f"SELECT p.sim, p.frame, p.node, {body} FROM (SELECT p.*, node_type, rx, ry, rz, least(CAST(floor({t}) AS INT), last) AS lo, least(CAST(floor({t}) AS INT) + 1, last) AS hi, {t} - floor({t}) AS w FROM (SELECT *, max(frame) OVER (PARTITION BY sim) AS last FROM positions) p JOIN rest ON p.node = rest.node) p JOIN positions a ON a.sim = p.sim AND a.node = p.node AND a.frame = lo JOIN positions b ON b.sim = p.sim AND b.node = p.node AND b.frame = hi", "positions")


for _kind, _value in (("scale", 0.1), ("lag", 10), ("timescale", 0.95)):

    @query(f"i7_global_{_kind}", _global_oracle(_kind, _value), zero=("x", "y", "z"))
    def _i7(spark, d, kind=_kind, value=_value):
        p, r = _views(spark, d, "positions", "rest")
        return rounded(inject.inject_global(p, r, kind, value), "x", "y", "z")


def _events(p: DataFrame) -> DataFrame:
    sims = p.select("sim").distinct()
    return sims.select("sim", F.explode(F.sequence(F.expr("cast(20 + sim % 7 as int)"), F.expr("cast(29 + sim % 11 as int)"))).alias("frame"))


EVENTS = ", ev AS (SELECT sim, unnest(range(20 + sim % 7, 30 + sim % 11)) AS frame FROM (SELECT DISTINCT sim FROM positions))"


@query("i10_choose_frames", oracle(EVENTS + f""", b AS (SELECT sim, min(frame) AS a, max(frame) AS b, count(*) AS n FROM ev GROUP BY sim), c AS (SELECT sim, a, b, n, unnest(range(greatest(a - 40, 2), least(b + 40, last) + 1)) AS frame FROM b JOIN (SELECT sim, max(frame) AS last FROM positions GROUP BY sim) e USING (sim)),
k AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY {DRAW.format("CAST(sim AS VARCHAR) || '|clean|' || CAST(frame AS VARCHAR)")}, frame) AS r FROM c WHERE frame < greatest(a - 3, 0) OR frame > b + 3)
SELECT ev.sim, CAST(ev.frame AS INT) AS frame, true AS label, CASE WHEN ev.frame = a THEN 'onset' ELSE 'sustained' END AS phase FROM ev JOIN b ON ev.sim = b.sim UNION ALL SELECT sim, CAST(frame AS INT), false, 'clean' FROM k WHERE r <= greatest(4, n)""", "positions"))
def i10(spark, d):
    p = view(spark, d, "positions")
    return inject.choose_frames(_events(p), t_max=mesh.run_lengths(p), keys=("sim",)).withColumn("frame", F.col("frame").cast("int"))


@query("d1_constvel_scores", oracle(CONSTVEL + " SELECT sim, frame, node, round(score, 6) AS score FROM cv", "positions"))
def d1(spark, d):
    return rounded(detect.constvel_scores(view(spark, d, "positions")), "score")


@query("d2_residual_scores", oracle("""SELECT sim, frame, node, round(sqrt((dx-ax)*(dx-ax)+dy*dy+dz*dz), 6) AS score FROM (SELECT sim, frame, node, x - (2*lag(x, 1) OVER t - lag(x, 2) OVER t) AS dx, y - (2*lag(y, 1) OVER t - lag(y, 2) OVER t) AS dy, z - (2*lag(z, 1) OVER t - lag(z, 2) OVER t) AS dz, node*1e-3 AS ax FROM positions WINDOW t AS (PARTITION BY sim, node ORDER BY frame)) q WHERE dx IS NOT NULL""", "positions"))
def d2(spark, d):
    p = view(spark, d, "positions")
    predicted = p.select("sim", "frame", "node", (F.col("node") * 1e-3).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"))
    return rounded(detect.residual_scores(p, predicted), "score")


@query("d3_velocity_scores", oracle(STEPS + ", m AS (SELECT *, abs(speed - quantile_cont(speed, 0.5) OVER (PARTITION BY sim, node)) AS dev FROM speed), q AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY sim, node) AS mad FROM m) SELECT sim, frame, node, round(dev / (14826e-4*mad + 1e-9), 5) AS score FROM q", "positions"))
def d3(spark, d):
    return rounded(detect.velocity_scores(view(spark, d, "positions")), "score", digits=5)


LAP = DISP + ", m AS (SELECT d.sim, d.frame, dst AS node, avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz FROM disp d JOIN edges ON d.node = src GROUP BY d.sim, d.frame, dst), lap AS (SELECT d.sim, d.frame, d.node, sqrt((ux-coalesce(mx,0))*(ux-coalesce(mx,0))+(uy-coalesce(my,0))*(uy-coalesce(my,0))+(uz-coalesce(mz,0))*(uz-coalesce(mz,0))) AS score FROM disp d LEFT JOIN m ON d.sim = m.sim AND d.frame = m.frame AND d.node = m.node)"
VLAP = STEPS + ", vm AS (SELECT d.sim, d.frame, dst AS node, avg(vx) AS mx, avg(vy) AS my, avg(vz) AS mz FROM speed d JOIN edges ON d.node = src GROUP BY d.sim, d.frame, dst), vlap AS (SELECT d.sim, d.frame, d.node, sqrt((vx-coalesce(mx,0))*(vx-coalesce(mx,0))+(vy-coalesce(my,0))*(vy-coalesce(my,0))+(vz-coalesce(mz,0))*(vz-coalesce(mz,0))) AS score FROM speed d LEFT JOIN vm m ON d.sim = m.sim AND d.frame = m.frame AND d.node = m.node)"


@query("d4_laplacian_scores", oracle(LAP + " SELECT sim, frame, node, round(score, 6) AS score FROM lap", "positions", "edges"))
def d4(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    return rounded(detect.laplacian_scores(p, r, mesh.mesh_edges(c)), "score")


@query("d5_vlap_scores", oracle(VLAP + " SELECT sim, frame, node, round(score, 6) AS score FROM vlap", "positions", "edges"))
def d5(spark, d):
    return rounded(by_run(spark, d, lambda p, r, c: detect.velocity_laplacian_scores(p, mesh.mesh_edges(c))), "score")


@query("d6_velocity_causal", oracle(STEPS + """, pr AS (SELECT n.sim, n.frame, n.node, n.speed, p.speed AS past FROM speed n JOIN speed p ON n.sim = p.sim AND n.node = p.node AND p.frame <= greatest(n.frame - 4, 5)), ce AS (SELECT sim, frame, node, speed, quantile_cont(past, 0.5) AS c FROM pr GROUP BY ALL),
ma AS (SELECT ce.sim, ce.frame, ce.node, ce.speed, c, quantile_cont(abs(past - c), 0.5) AS mad FROM ce JOIN pr ON ce.sim = pr.sim AND ce.frame = pr.frame AND ce.node = pr.node GROUP BY ALL) SELECT sim, frame, node, round(abs(speed - c) / (14826e-4*mad + 1e-9), 4) AS score FROM ma""", "positions"))
def d6(spark, d):
    return rounded(detect.velocity_causal_scores(view(spark, d, "positions")), "score", digits=4)


BADCELL = VOL + RESTVOL + ", bad AS (SELECT sim, frame, vol.cell FROM vol JOIN rv ON vol.cell = rv.cell WHERE sign(volume) <> sign(rest_volume))"


@query("d8_jacobian_scores", oracle(COPY.replace("x + 1e0 AS x", "x + 60e0 AS x") + BADCELL.replace("positions", "cp") + ", n AS (SELECT sim, frame, node, count(*) AS n FROM (SELECT sim, frame, unnest([v0,v1,v2,v3]) AS node FROM bad JOIN cells ON bad.cell = cells.cell) q GROUP BY ALL) SELECT p.sim, p.frame, p.node, CAST(coalesce(n, 0) AS DOUBLE) AS score FROM cp p LEFT JOIN n ON p.sim = n.sim AND p.frame = n.frame AND p.node = n.node", "positions", "cells"))
def d8(spark, d):
    moved = lambda p: mesh.apply_deltas(p, changed(p).withColumn("x", F.col("x") - 1.0 + 60.0))
    return by_run(spark, d, lambda p, r, c: detect.jacobian_scores(moved(p), r, c))


@query("d9_frame_scores", oracle(CONSTVEL + f" SELECT sim, frame, round(score, 6) AS score FROM {FRAME.format('cv')}", "positions"))
def d9(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(detect.frame_scores(detect.constvel_scores(p), r), "score")


@query("d10_jacobian_frame", oracle(COPY.replace("x + 1e0 AS x", "x + 60e0 AS x") + BADCELL.replace("positions", "cp") + ", n AS (SELECT sim, frame, node, count(*) AS n FROM (SELECT sim, frame, unnest([v0,v1,v2,v3]) AS node FROM bad JOIN cells ON bad.cell = cells.cell) q GROUP BY ALL) SELECT p.sim, p.frame, sum(coalesce(n, 0)) / 4e0 AS score FROM cp p LEFT JOIN n ON p.sim = n.sim AND p.frame = n.frame AND p.node = n.node WHERE p.node <= 4 GROUP BY p.sim, p.frame", "positions", "cells"))
def d10(spark, d):
    p, r, c = _views(spark, d, "positions", "rest", "cells")
    moved = mesh.apply_deltas(p, changed(p).withColumn("x", F.col("x") - 1.0 + 60.0))
    return detect.jacobian_frame_scores(detect.jacobian_scores(moved, r, c), r)


def _plane(a: str, b: str, c: str, o: str) -> str:
    """Distance of a plate node p from the plane of a face, positive on the side of the opposite corner o: SQL."""
    n = [f"(({b}.{u}-{a}.{u})*({c}.{v}-{a}.{v})-({b}.{v}-{a}.{v})*({c}.{u}-{a}.{u}))" for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
    over = lambda q: "(" + "+".join(f"({q}.{k}-{a}.{k})*{m}" for k, m in zip("xyz", n, strict=True)) + ")"
    return f"{over('p')} * sign({over(o)}) / sqrt({'+'.join(m + '*' + m for m in n)})"


FACES = [_plane(*order) for order in (("a", "b", "c", "e"), ("a", "b", "e", "c"), ("a", "c", "e", "b"), ("b", "c", "e", "a"))]
#: The actuator is one tet: a node inside it is as deep as its nearest face's plane is far.
DEPTH = ", dp AS (SELECT p.sim, p.frame, p.node, greatest(0e0, least(" + ", ".join(FACES) + ")) AS depth FROM positions p " + " ".join(f"JOIN positions {k} ON {k}.node = {i} AND {k}.sim = p.sim AND {k}.frame = p.frame" for k, i in zip("abce", (5, 6, 7, 8), strict=True)) + " WHERE p.node <= 4)"


@query("d13_bundle_features", oracle(STEPS + CONSTVEL + LAP + VLAP.removeprefix(STEPS) + """, st AS (SELECT sim, sqrt(avg(speed*speed)) AS step FROM speed WHERE node <= 4 GROUP BY sim), al AS (SELECT sim, frame, node, speed AS score, 'speed' AS kind FROM speed UNION ALL SELECT sim, frame, node, score, 'acceleration' FROM cv UNION ALL SELECT sim, frame, node, score, 'laplacian' FROM lap UNION ALL SELECT sim, frame, node, score, 'vlap' FROM vlap),
q AS (SELECT al.sim, frame, kind, quantile_cont(score / (step + 1e-12), [0.5, 0.9, 0.99, 1.0]) AS p FROM al JOIN st ON al.sim = st.sim WHERE node <= 4 GROUP BY ALL), tall AS (SELECT sim, frame, kind || '_' || unnest(['50', '90', '99', '100']) AS name, unnest(p) AS v FROM q) SELECT sim, frame, name, round(ln(1 + v), 5) AS value FROM tall WHERE frame >= 2 UNION ALL SELECT DISTINCT sim, frame, 'inverted', 0e0 FROM positions WHERE frame >= 2
UNION ALL SELECT dp.sim, frame, 'depth', round(ln(1 + max(depth) / (max(step) + 1e-12)), 5) FROM dp JOIN st ON dp.sim = st.sim WHERE frame >= 2 GROUP BY dp.sim, frame""".replace(", st AS (", DEPTH + ", st AS (", 1), "positions", "edges"))
def d13(spark, d):
    return rounded(by_run(spark, d, lambda p, r, c: detect.bundle_features(p, r, mesh.mesh_edges(c), c), 1 << 25), "value", digits=5)


CAL = CONSTVEL + ", lv AS (SELECT sim, node, quantile_cont(score, 0.5) AS c FROM cv WHERE frame % 10 = 5 GROUP BY sim, node), pl AS (SELECT sim, quantile_cont(c, 0.5) AS plate FROM lv WHERE node <= 4 GROUP BY sim)"


@query("c1_calibrated", oracle(CAL + " SELECT cv.sim, frame, cv.node, round(score / (c + plate + 1e-12), 5) AS score FROM cv JOIN lv ON cv.sim = lv.sim AND cv.node = lv.node JOIN pl ON cv.sim = pl.sim", "positions"))
def c1(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(detect.calibrated(detect.constvel_scores(p), r, CALIB), "score", digits=5)


@query("c2_calibrated_causal", oracle(CONSTVEL + """, k AS (SELECT sim, node, score, row_number() OVER (PARTITION BY sim, node ORDER BY frame) AS n FROM cv WHERE frame % 10 = 5), lv AS (SELECT a.sim, a.node, a.n, quantile_cont(b.score, 0.5) AS c FROM k a JOIN k b ON a.sim = b.sim AND a.node = b.node AND b.n <= a.n GROUP BY ALL), pl AS (SELECT sim, n, quantile_cont(c, 0.5) AS plate FROM lv WHERE node <= 4 GROUP BY sim, n)
SELECT s.sim, s.frame, s.node, round(score / (c + plate + 1e-12), 5) AS score FROM (SELECT *, greatest(3, CAST(floor((frame + 1)/10e0) AS INT)) AS n FROM cv) s JOIN lv ON s.sim = lv.sim AND s.node = lv.node AND s.n = lv.n JOIN pl ON s.sim = pl.sim AND s.n = pl.n""", "positions"))
def c2(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(detect.calibrated_causal(detect.constvel_scores(p), r, CALIB), "score", digits=5)


@query("c3_step_scale", oracle(STEPS + " SELECT sim, round(sqrt(avg(speed*speed)), 6) AS step FROM speed WHERE node <= 4 GROUP BY sim", "positions"))
def c3(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(detect.step_scale(p, r), "step")


@query("c4_actuator_step", oracle(STEPS + " SELECT sim, round(sqrt(avg(speed*speed)) + 1e-12, 6) AS step FROM speed WHERE node >= 5 AND frame < 50 GROUP BY sim", "positions"))
def c4(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    return rounded(detect.step_scale(p, r, mesh.OBSTACLE, 50, 1e-12), "step")


@query("c7_standardizer", oracle(CONSTVEL + " SELECT node, round(avg(score), 6) AS mean, round(greatest(stddev_pop(score), 1e-8), 5) AS std FROM cv GROUP BY node", "positions"))
def c7(spark, d):
    fit = detect.fit_standardizer(detect.constvel_scores(view(spark, d, "positions")), "score", ("node",))
    return rounded(rounded(fit, "mean"), "std", digits=5)


@query("w4_stride", oracle("SELECT sim, frame, node FROM positions WHERE frame >= 10 AND frame < 50 AND (frame - 10) % 4 = 0", "positions"))
def w4(spark, d):
    return detect.stride(view(spark, d, "positions"), 10, 50, 4).select("sim", "frame", "node")


RUNS = CONSTVEL + STEPS + f", fs AS {FRAME.format('cv')}, st AS (SELECT sim, sqrt(avg(speed*speed)) AS step FROM speed WHERE node <= 4 GROUP BY sim), rs AS (SELECT fs.sim, 'constvel' AS detector, quantile_cont(score, 0.5) / step AS value FROM fs JOIN st ON fs.sim = st.sim GROUP BY fs.sim, step)"


def _run_values(spark, d) -> DataFrame:
    p, r = _views(spark, d, "positions", "rest")
    frames = detect.frame_scores(detect.constvel_scores(p), r).withColumn("detector", F.lit("constvel"))
    return alarms.run_stats(frames, detect.step_scale(p, r))


@query("r1_run_stats", oracle(RUNS + " SELECT sim, detector, round(value, 6) AS value FROM rs", "positions"))
def r1(spark, d):
    return rounded(_run_values(spark, d), "value")


@query("r3_shape_run_stats", oracle(DISP + " SELECT sim, round(ln(greatest(sum(ux*(ux*9e-1+1e-2)+uy*uy*9e-1+uz*uz*9e-1) / sum((ux*9e-1+1e-2)*(ux*9e-1+1e-2)+uy*9e-1*uy*9e-1+uz*9e-1*uz*9e-1), 1e-6)), 5) AS shape_scale, round(sqrt(sum((ux-(ux*9e-1+1e-2))*(ux-(ux*9e-1+1e-2))+(uy-uy*9e-1)*(uy-uy*9e-1)+(uz-uz*9e-1)*(uz-uz*9e-1)) / sum((ux*9e-1+1e-2)*(ux*9e-1+1e-2)+uy*9e-1*uy*9e-1+uz*9e-1*uz*9e-1)), 5) AS shape_resid FROM disp WHERE node <= 4 GROUP BY sim", "positions"))
def r3(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    u = mesh.displacement(p, r).where("node_type = 0").select("sim", "frame", "node", "ux", "uy", "uz")
    predicted = u.select("sim", "frame", "node", (F.col("ux") * 0.9 + 0.01).alias("ux"), (F.col("uy") * 0.9).alias("uy"), (F.col("uz") * 0.9).alias("uz"))
    return rounded(alarms.shape_run_stats(u, predicted, ("sim", "frame", "node")), "shape_scale", "shape_resid", digits=5)


@query("r4_robust_z", oracle(RUNS + ", md AS (SELECT quantile_cont(value, 0.5) AS med FROM rs WHERE sim % 2 = 0), mm AS (SELECT med, quantile_cont(abs(value - med), 0.5) AS mad FROM rs, md WHERE sim % 2 = 0 GROUP BY med) SELECT sim, detector, round(value, 6) AS value, round(abs(value - med) / (14826e-4*mad + 1e-12), 4) AS z FROM rs, mm WHERE sim % 2 = 1", "positions"))
def r4(spark, d):
    values = _run_values(spark, d)
    return rounded(rounded(alarms.robust_z(values.where("sim % 2 = 1"), values.where("sim % 2 = 0")), "value"), "z", digits=4)


@query("l4_event_bounds", oracle(", dv AS (SELECT sim, 'blowup' AS kind, frame, CASE WHEN frame BETWEEN 20 + sim % 5 AND 40 THEN least(pow(13e-1, frame - 20), 50e0) ELSE 0e0 END AS deviation FROM (SELECT DISTINCT sim, frame FROM positions)), o AS (SELECT *, max(deviation) OVER (PARTITION BY sim) AS most FROM dv WHERE deviation > 0) SELECT sim, kind, min(frame) AS t0, min(CASE WHEN deviation >= 999e-3*most THEN frame END) AS \"end\", greatest(min(frame) - 15, 2) AS start FROM o GROUP BY sim, kind", "positions"))
def l4(spark, d):
    frames = view(spark, d, "positions").select("sim", "frame").distinct()
    dev = F.when(F.expr("frame between 20 + sim % 5 and 40"), F.least(F.pow(F.lit(1.3), F.col("frame") - 20), F.lit(50.0))).otherwise(0.0)
    return alarms.event_bounds(frames.select("sim", F.lit("blowup").alias("kind"), "frame", dev.alias("deviation")))


def _leads(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    scores = detect.frame_scores(detect.constvel_scores(p), r).withColumn("detector", F.lit("constvel"))
    events = p.select("sim").distinct().select("sim", F.when(F.col("sim") % 2 == 0, "blowup").otherwise("frozen").alias("kind"), F.expr("cast(20 + sim % 5 as int)").alias("t0"), F.expr("cast(45 + sim % 5 as int)").alias("end"), F.expr("cast(greatest(5 + sim % 5, 2) as int)").alias("start"))
    return scores, events


LEADS = CONSTVEL + f", fs AS {FRAME.format('cv')}, ev AS (SELECT sim, CASE WHEN sim % 2 = 0 THEN 'blowup' ELSE 'frozen' END AS kind, CAST(20 + sim % 5 AS INT) AS t0, CAST(45 + sim % 5 AS INT) AS e FROM (SELECT DISTINCT sim FROM positions)), th AS (SELECT quantile_cont(score, 0.95) AS threshold FROM fs JOIN ev ON fs.sim = ev.sim WHERE frame < t0 - 3), fa AS (SELECT fs.sim, kind, t0, e, min(CASE WHEN score > threshold THEN frame END) AS first FROM fs JOIN ev ON fs.sim = ev.sim, th WHERE frame >= t0 AND frame <= e GROUP BY ALL)"


@query("l3_frame_threshold", oracle(LEADS + " SELECT 'constvel' AS detector, round(threshold, 6) AS threshold FROM th", "positions"))
def l3(spark, d):
    return rounded(alarms.frame_threshold(*_leads(spark, d)), "threshold")


@query("l5_lead_times", oracle(LEADS + " SELECT sim, kind, 'constvel' AS detector, first, CASE WHEN kind = 'blowup' THEN e - first ELSE first - t0 END AS lead FROM fa", "positions"))
def l5(spark, d):
    scores, events = _leads(spark, d)
    return alarms.lead_times(scores, events, alarms.frame_threshold(scores, events))


SUMMARY = LEADS + """, ld AS (SELECT sim, kind, first, CASE WHEN kind = 'blowup' THEN e - first ELSE first - t0 END AS lead FROM fa), rk AS (SELECT kind, lead, row_number() OVER (PARTITION BY kind ORDER BY sim) AS i, count(*) OVER (PARTITION BY kind) AS n FROM ld WHERE lead IS NOT NULL),
pk AS (SELECT kind, rep, ('0x' || substr(md5('0|' || CAST(rep AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)), 1, 8))::BIGINT % n + 1 AS i FROM rk, (SELECT unnest(range(1000)) AS rep) r), bm AS (SELECT pk.kind, rep, quantile_cont(lead, 0.5) AS m FROM pk JOIN rk ON pk.kind = rk.kind AND pk.i = rk.i GROUP BY pk.kind, rep), ci AS (SELECT kind, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY kind),
fr AS (SELECT kind, avg(CASE WHEN score > threshold THEN 1e0 ELSE 0e0 END) AS false_alarm_rate FROM fs JOIN ev ON fs.sim = ev.sim, th WHERE frame >= greatest(t0 - 15, 2) AND frame < t0 - 3 GROUP BY kind)
SELECT ld.kind, 'constvel' AS detector, count(*) AS n, round(avg(CASE WHEN first IS NULL THEN 0e0 ELSE 1e0 END), 6) AS detected, round(quantile_cont(lead, 0.5), 6) AS median_lead, round(max(lo), 6) AS lo, round(max(hi), 6) AS hi, round(coalesce(max(false_alarm_rate), 0), 6) AS false_alarm_rate FROM ld LEFT JOIN ci ON ci.kind = ld.kind LEFT JOIN fr ON fr.kind = ld.kind GROUP BY ld.kind"""


@query("l6_lead_summary", oracle(SUMMARY, "positions"))
def l6(spark, d):
    scores, events = _leads(spark, d)
    return rounded(alarms.lead_summary(scores, events, alarms.frame_threshold(scores, events)), "detected", "median_lead", "lo", "hi", "false_alarm_rate")


@query("flagship_injected_auroc", oracle(", allp AS (SELECT sim, frame, node, x, y, z, 'clean' AS copy FROM positions UNION ALL SELECT p.sim, p.frame, p.node, CASE WHEN node_type = 0 THEN rx + 15e-1*(x-rx) ELSE x END, CASE WHEN node_type = 0 THEN ry + 15e-1*(y-ry) ELSE y END, CASE WHEN node_type = 0 THEN rz + 15e-1*(z-rz) ELSE z END, 'scale' FROM positions p JOIN rest ON p.node = rest.node), cv AS (SELECT sim, copy, frame, node, sqrt(dx*dx+dy*dy+dz*dz) AS score FROM (SELECT sim, copy, frame, node, x - (2*lag(x, 1) OVER t - lag(x, 2) OVER t) AS dx, y - (2*lag(y, 1) OVER t - lag(y, 2) OVER t) AS dy, z - (2*lag(z, 1) OVER t - lag(z, 2) OVER t) AS dz FROM allp WINDOW t AS (PARTITION BY sim, copy, node ORDER BY frame)) q WHERE dx IS NOT NULL), fs AS (SELECT sim, copy, frame, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sim, copy, frame ORDER BY score DESC, node) AS r FROM cv WHERE node <= 4) q WHERE r <= 5 GROUP BY ALL) SELECT 'constvel' AS detector, round((SELECT count(*) FROM fs a, fs b WHERE a.copy = 'scale' AND b.copy = 'clean' AND round(a.score, 9) > round(b.score, 9)) * 1e0 / ((SELECT count(*) FROM fs WHERE copy = 'scale') * (SELECT count(*) FROM fs WHERE copy = 'clean')) + 5e-1 * (SELECT count(*) FROM fs a, fs b WHERE a.copy = 'scale' AND b.copy = 'clean' AND round(a.score, 9) = round(b.score, 9)) / ((SELECT count(*) FROM fs WHERE copy = 'scale') * (SELECT count(*) FROM fs WHERE copy = 'clean')), 5) AS auroc", "positions"))
def flagship(spark, d):
    p, r = _views(spark, d, "positions", "rest")
    scored = lambda q, label: detect.frame_scores(detect.constvel_scores(q), r).withColumn("label", F.lit(label))
    both = scored(p, False).unionByName(scored(inject.inject_global(p, r, "scale", 0.5), True)).withColumn("detector", F.lit("constvel")).withColumn("score", F.round("score", 9))
    return rounded(metrics.auroc(both, ["detector"]), "auroc", digits=5)
