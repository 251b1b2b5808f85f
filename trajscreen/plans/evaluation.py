"""Registered queries over records, embeddings and answers: metrics, resampling, thresholds, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajscreen.functions.columns import draw, jaccard, log1p_abs, softmax, terms
from trajscreen.operators import alarms, answers, detect, metrics, resample
from trajscreen.plans.fixtures import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
REPS = 500  # of cells
GATE_REPS = 2000  # of gates and run-level statistics
MEDIAN_REPS = PERMUTATIONS = 1000
LABELS = tuple(f"type{i}" for i in range(6))
STEMS = ("the", "tion", "and", "here", "ing", "ent", "on", "er", "of", "re")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def ranked(source: str, keys: str) -> str:
    """AUROC by keys: SQL."""
    return f"SELECT {keys}, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN (sum(CASE WHEN label THEN rk ELSE 0 END) - max(np)*(max(np)+1)/2e0) / (max(np)*1e0*max(nn)) END AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1)/2e0 AS rk, sum(label::INT) OVER (PARTITION BY {keys}) AS np, sum((NOT label)::INT) OVER (PARTITION BY {keys}) AS nn FROM {source}) q GROUP BY {keys}"


CELLS = ", pc AS (SELECT tall.*, unnest(CASE WHEN phase = 'clean' THEN ['all', 'onset', 'sustained'] ELSE ['all', phase] END) AS cell_phase FROM tall)"
CELLM = CELLS + f", au AS ({ranked('pc', 'type, sev, cell_phase, detector')}), th AS (SELECT type, sev, cell_phase, detector, quantile_cont(score, 0.95) AS threshold FROM pc WHERE NOT label GROUP BY ALL), tp AS (SELECT type, sev, cell_phase, detector, avg(CASE WHEN score > threshold THEN 1e0 ELSE 0e0 END) AS tpr FROM pc JOIN th USING (type, sev, cell_phase, detector) WHERE label GROUP BY ALL), cm AS (SELECT type, sev, cell_phase, detector, auroc, tpr FROM au JOIN tp USING (type, sev, cell_phase, detector) WHERE auroc IS NOT NULL)"


@query("a1_auroc", oracle(f" SELECT type, sev, detector, round(auroc, 6) AS auroc FROM ({ranked('tall', 'type, sev, detector')}) a", "tall"))
def a1(spark, d):
    return rounded(metrics.auroc(view(spark, d, "tall"), ["type", "sev", "detector"]), "auroc")


@query("a2_node_auroc", oracle(f", tt AS (SELECT sim, CAST(FLOOR(frame/10e0) AS INT) AS frame, detector, label, score FROM tall), au AS ({ranked('tt', 'sim, frame, detector')}) SELECT detector, round(avg(auroc), 6) AS node_auroc FROM au WHERE auroc IS NOT NULL GROUP BY detector", "tall"))
def a2(spark, d):
    t = view(spark, d, "tall").select("sim", F.expr("cast(floor(frame/10e0) as int)").alias("frame"), F.col("frame").alias("node"), "detector", "label", "score")
    return rounded(metrics.node_auroc(t.drop("label"), t.where("label").select("sim", "frame", "node").distinct(), ["detector"]), "node_auroc")


@query("a3_tpr_at_fpr", oracle(CELLM + " SELECT type, sev, detector, round(tpr, 6) AS tpr FROM cm WHERE cell_phase = 'all'", "tall"))
def a3(spark, d):
    return rounded(metrics.tpr_at_fpr(view(spark, d, "tall"), ["type", "sev", "detector"]), "tpr")


@query("a4_cell_metrics", oracle(CELLM + " SELECT type, sev, cell_phase, detector, round(auroc, 6) AS auroc, round(tpr, 6) AS tpr FROM cm", "tall"))
def a4(spark, d):
    return rounded(metrics.cell_metrics(view(spark, d, "tall")), "auroc", "tpr")


@query("a5_phase_table", oracle(CELLM + " SELECT type, cell_phase, round(avg(CASE WHEN detector = 'a' THEN auroc END), 6) AS a, round(avg(CASE WHEN detector = 'b' THEN auroc END), 6) AS b FROM cm GROUP BY type, cell_phase", "tall"))
def a5(spark, d):
    return rounded(metrics.phase_table(metrics.cell_metrics(view(spark, d, "tall")), ["a", "b"]), "a", "b")


@query("a6_median_shift", oracle(" SELECT type, sev, round(quantile_cont(score_b, 0.5), 6) AS median_shift FROM records WHERE label GROUP BY type, sev", "records"))
def a6(spark, d):
    return rounded(metrics.median_shift(view(spark, d, "records").where("label").withColumnRenamed("score_b", "shift"), ["type", "sev"]), "median_shift")


@query("a7_best_baselines", oracle(CELLM + " SELECT type, sev, detector, auroc FROM (SELECT type, sev, detector, round(auroc, 4) AS auroc, row_number() OVER (PARTITION BY type, sev ORDER BY round(auroc, 4) DESC, CASE detector WHEN 'b' THEN 0 ELSE 1 END) AS r FROM cm WHERE cell_phase = 'all') q WHERE r = 1", "tall"))
def a7(spark, d):
    return metrics.best_baselines(metrics.cell_metrics(view(spark, d, "tall")), ["b", "a"])


@query("a8_rmse_vs_baseline", oracle(" SELECT type, round(sqrt(avg((score_a-score_b)*(score_a-score_b))), 5) AS rmse, round(sqrt(avg(score_b*score_b)), 5) AS baseline, round(sqrt(avg((score_a-score_b)*(score_a-score_b))) / sqrt(avg(score_b*score_b)), 6) AS ratio, sqrt(avg((score_a-score_b)*(score_a-score_b))) <= 5e-1 * sqrt(avg(score_b*score_b)) AS admitted FROM records WHERE label GROUP BY type", "records"))
def a8(spark, d):
    return rounded(rounded(metrics.rmse_vs_baseline(view(spark, d, "records"), "score_a", "score_b", "label", ["type"]), "rmse", "baseline", digits=5), "ratio")


ANS = ", an AS (SELECT conv_id, turn, arm, 'type' || truth_id AS truth, 'c' || truth_cell AS truth_location, CASE WHEN (conv_id*3+turn) % 11 <> 0 AND (conv_id*5+turn) % 13 <> 0 THEN 'type' || type_id END AS pred, CASE WHEN (conv_id*3+turn) % 11 <> 0 AND (conv_id*5+turn) % 13 <> 0 THEN 'c' || cell_id END AS location FROM answers)"


def _answers(spark, d) -> DataFrame:
    a = view(spark, d, "answers").withColumn("p", answers.parse_answer(F.col("raw"), LABELS))
    return a.select("conv_id", "turn", "arm", F.concat(F.lit("type"), F.col("truth_id").cast("string")).alias("truth"), F.concat(F.lit("c"), F.col("truth_cell").cast("string")).alias("truth_location"), F.col("p.anomaly_type").alias("pred"), F.col("p.location").alias("location"))


@query("x1_parse_answer", oracle(ANS + " SELECT conv_id, turn, arm, pred, location FROM an", "answers"))
def x1(spark, d):
    return _answers(spark, d).select("conv_id", "turn", "arm", "pred", "location")


@query("a9_confusion", oracle(ANS + " SELECT truth, " + ", ".join(f"count(CASE WHEN pred = 'type{i}' THEN 1 END) AS type{i}" for i in range(6)) + ", count(CASE WHEN pred IS NULL THEN 1 END) AS invalid FROM an GROUP BY truth", "answers"))
def a9(spark, d):
    return metrics.confusion(_answers(spark, d), LABELS)


@query("a10_score_answers", oracle(ANS + ", base AS (SELECT arm, avg(CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END) AS accuracy, avg(CASE WHEN pred IS NULL THEN 0e0 ELSE 1e0 END) AS valid_rate, avg(CASE WHEN location = truth_location THEN 1e0 ELSE 0e0 END) AS location_accuracy, avg(CASE WHEN (conv_id + 2*turn) % 3 = 0 THEN CASE WHEN pred = truth THEN 1e0 ELSE 0e0 END END) AS flagged_accuracy, count(CASE WHEN (conv_id + 2*turn) % 3 = 0 THEN 1 END) AS n_flagged FROM an GROUP BY arm), pl AS (SELECT arm, l, count(CASE WHEN truth = l AND pred = l THEN 1 END) AS tp, count(CASE WHEN truth = l THEN 1 END) AS t, count(CASE WHEN pred = l THEN 1 END) AS p FROM an, (SELECT unnest(['type0','type1','type2','type3','type4','type5']) AS l) x GROUP BY arm, l) SELECT base.arm, round(accuracy, 6) AS accuracy, round(valid_rate, 6) AS valid_rate, round(location_accuracy, 6) AS location_accuracy, round(flagged_accuracy, 6) AS flagged_accuracy, n_flagged, round(avg(CASE WHEN t + p > 0 THEN 2e0*tp/(t+p) ELSE 0e0 END), 6) AS macro_f1 FROM base JOIN pl ON base.arm = pl.arm GROUP BY ALL", "answers"))
def a10(spark, d):
    flagged = _answers(spark, d).withColumn("flagged", F.expr("(conv_id + 2*turn) % 3 = 0"))
    return rounded(metrics.score_answers(flagged, LABELS), "accuracy", "valid_rate", "location_accuracy", "flagged_accuracy", "macro_f1")


@query("a11_majority_baseline", oracle(ANS + " SELECT arm, value, round(share, 6) AS share FROM (SELECT arm, truth AS value, count(*)*1e0/sum(count(*)) OVER (PARTITION BY arm) AS share, row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, truth) AS r FROM an GROUP BY arm, truth) q WHERE r = 1", "answers"))
def a11(spark, d):
    return rounded(metrics.majority_baseline(_answers(spark, d), "truth", ["arm"]), "share")


@query("a12_ece", oracle(" SELECT round(sum(abs(acc - mc)*n)/sum(n), 6) AS ece FROM (SELECT least(floor(conf*15), 14) AS b, count(*) AS n, avg(correct) AS acc, avg(conf) AS mc FROM confidence GROUP BY b) q", "confidence"))
def a12(spark, d):
    return rounded(metrics.ece(view(spark, d, "confidence")), "ece")


@query("a12_brier", oracle(" SELECT round(avg((conf-correct)*(conf-correct)), 6) AS brier FROM confidence", "confidence"))
def a12b(spark, d):
    return rounded(metrics.brier(view(spark, d, "confidence")), "brier")


PAIRS = ANS + ", pr AS (SELECT a.arm, a.conv_id, a.pred AS pred_a, b.pred AS pred_b FROM an a JOIN an b ON a.arm = b.arm AND b.conv_id = a.conv_id + 1 AND a.turn = b.turn)"


def _answer_pairs(spark, d) -> DataFrame:
    a = _answers(spark, d)
    other = a.select("arm", (F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("pred").alias("pred_b"))
    return a.select("arm", "conv_id", "turn", F.col("pred").alias("pred_a")).join(other, ["arm", "conv_id", "turn"])


@query("a13_pilot_report", oracle(PAIRS + " SELECT arm, round(avg(CASE WHEN pred_a = 'type0' THEN 1e0 ELSE 0e0 END), 6) AS none_a, round(avg(CASE WHEN pred_b = 'type1' THEN 1e0 ELSE 0e0 END), 6) AS target_b, round(avg(CASE WHEN pred_a = 'type0' AND pred_b IS NOT NULL AND pred_b <> 'type0' THEN 1e0 ELSE 0e0 END), 6) AS separated, round(avg(CASE WHEN coalesce(pred_a, '') = coalesce(pred_b, '') THEN 1e0 ELSE 0e0 END), 6) AS similarity FROM pr GROUP BY arm", "answers"))
def a13(spark, d):
    pairs = _answer_pairs(spark, d).withColumn("similarity", (F.coalesce("pred_a", F.lit("")) == F.coalesce("pred_b", F.lit(""))).cast("double"))
    return rounded(answers.pair_metrics(pairs, "type0", "type1"), "none_a", "target_b", "separated", "similarity")


PILOT = PAIRS + ", rt AS (SELECT arm, sum(CASE WHEN truth <> 'type0' AND pred = truth THEN 1 ELSE 0 END) AS type_right, count(CASE WHEN truth <> 'type0' THEN 1 END) AS n_anomalous, sum(CASE WHEN truth <> 'type0' AND pred = 'type0' THEN 1 ELSE 0 END) AS none_on_anomalous, sum(CASE WHEN truth = 'type0' AND pred = 'type0' THEN 1 ELSE 0 END) AS clean_called_none, count(CASE WHEN truth = 'type0' THEN 1 END) AS n_clean, sum(CASE WHEN truth <> 'type0' AND pred IS NOT NULL AND location = truth_location THEN 1 ELSE 0 END) AS location_right, count(CASE WHEN truth <> 'type0' AND pred IS NOT NULL THEN 1 END) AS n_located, sum(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS invalid, count(*) AS n FROM an GROUP BY arm), sp AS (SELECT arm, sum(CASE WHEN pred_a = 'type0' AND pred_b IS NOT NULL AND pred_b <> 'type0' THEN 1 ELSE 0 END) AS separated, count(*) AS n_pairs FROM pr GROUP BY arm), bs AS (SELECT max(type_right) AS base FROM rt WHERE arm = 'assistant')"


@query("a13_pilot_decision", oracle(PILOT + " SELECT rt.*, coalesce(separated, 0) AS separated, coalesce(n_pairs, 0) AS n_pairs, type_right - base >= 5 OR coalesce(separated, 0) >= 3 AS scale_up FROM bs, rt LEFT JOIN sp ON rt.arm = sp.arm", "answers"))
def a13b(spark, d):
    return answers.pilot_report(_answers(spark, d), _answer_pairs(spark, d), "assistant", "type0")


@query("a14_gate_mean", oracle(CELLM + " SELECT detector, round(avg(auroc), 6) AS mean_auroc, avg(auroc) >= 8e-1 AS passed FROM cm WHERE sev = 3 GROUP BY detector", "tall"))
def a14(spark, d):
    return rounded(metrics.gate_mean(metrics.cell_metrics(view(spark, d, "tall"))), "mean_auroc")


@query("w2_selective", oracle(", s AS (SELECT conf, sum(correct) OVER w * 1e0 / row_number() OVER w AS cum, row_number() OVER w AS k, count(*) OVER () AS n FROM confidence WINDOW w AS (ORDER BY conf DESC, item ROWS UNBOUNDED PRECEDING)) SELECT round(max(CASE WHEN k = floor(n*0.8) THEN cum END), 6) AS acc_at_coverage, round(coalesce(max(CASE WHEN cum >= 9e-1 THEN k END) / max(n), 0), 6) AS coverage, round(coalesce(min(CASE WHEN cum >= 9e-1 THEN conf END), 1), 6) AS tau FROM s", "confidence"))
def w2(spark, d):
    return rounded(metrics.selective(view(spark, d, "confidence"), target=0.9), "acc_at_coverage", "coverage", "tau")


HALVES = ", s AS (SELECT conf, sum(correct) OVER w * 1e0 / row_number() OVER w AS cum, row_number() OVER w AS k FROM confidence WHERE item % 2 = 0 WINDOW w AS (ORDER BY conf DESC, item ROWS UNBOUNDED PRECEDING)), ta AS (SELECT coalesce(arg_max(conf, k) FILTER (WHERE cum >= 6e-1), 1) AS tau FROM s)"


@query("w3_abstain_rate", oracle(HALVES + " SELECT round(tau, 6) AS tau, round(avg(CASE WHEN conf < tau THEN 1e0 ELSE 0e0 END), 6) AS abstain_rate FROM confidence, ta WHERE item % 2 = 1 GROUP BY tau", "confidence"))
def w3(spark, d):
    c = view(spark, d, "confidence")
    tau = metrics.fit_tau(c.where("item % 2 = 0"), 0.6)
    return rounded(metrics.abstain_rate(c.where("item % 2 = 1"), tau).select(F.lit(tau).alias("tau"), "abstain_rate"), "tau", "abstain_rate")


@query("w5_stratified_sample", oracle(" SELECT sim, frame, type, sev FROM (SELECT *, row_number() OVER (PARTITION BY type, label ORDER BY ('0x' || substr(md5('s|' || CAST(sim AS VARCHAR) || '|' || CAST(frame AS VARCHAR)), 1, 8))::BIGINT, sim, frame) AS r FROM records) q WHERE r <= 20", "records"))
def w5(spark, d):
    return metrics.stratified_sample(view(spark, d, "records"), ["type", "label"], 20, draw("s", F.col("sim"), F.col("frame")), ["sim", "frame"]).select("sim", "frame", "type", "sev")


@query("j11_aligned", oracle(" SELECT sim, type, sev, frame, label, score_a AS score_x, score_b AS score_y FROM records", "records"))
def j11(spark, d):
    t = view(spark, d, "tall")
    return metrics.aligned(t.where("detector = 'a'"), t.where("detector = 'b'"))


WEIGHTS = f", cl AS (SELECT sim, row_number() OVER (ORDER BY sim) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sim FROM tall)), dr AS (SELECT rep, ('0x' || substr(md5('0|' || CAST(rep AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % n AS j FROM cl, (SELECT unnest(range({REPS})) AS rep) r), wt AS (SELECT rep, sim, count(*) AS weight FROM dr JOIN cl ON j = i GROUP BY rep, sim)"
BOOT = WEIGHTS + ", ag AS (SELECT type, detector, rep, score, sum(CASE WHEN label THEN weight ELSE 0 END) AS p, sum(CASE WHEN label THEN 0 ELSE weight END) AS n FROM tall JOIN wt ON tall.sim = wt.sim GROUP BY ALL), un AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY type, detector, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM ag), ba AS (SELECT type, detector, rep, sum(p*(u + n/2e0)) / (sum(p)*1e0*sum(n)) AS auroc FROM un GROUP BY ALL HAVING sum(p) > 0 AND sum(n) > 0)"
DELTAS = BOOT.replace(f"range({REPS})", f"range({GATE_REPS})") + ", de AS (SELECT a.type, a.rep, a.auroc - b.auroc AS delta FROM ba a JOIN ba b ON a.type = b.type AND a.rep = b.rep WHERE a.detector = 'a' AND b.detector = 'b')"


@query("b1_bootstrap_ci", oracle(BOOT + " SELECT c.type, c.detector, c.clusters, CASE WHEN max(clusters) >= 20 THEN round(quantile_cont(auroc, 0.025), 6) END AS lo, CASE WHEN max(clusters) >= 20 THEN round(quantile_cont(auroc, 0.975), 6) END AS hi FROM (SELECT type, detector, count(DISTINCT sim) AS clusters FROM tall GROUP BY type, detector) c LEFT JOIN ba ON c.type = ba.type AND c.detector = ba.detector GROUP BY ALL", "tall"))
def b1(spark, d):
    return rounded(resample.bootstrap_ci(view(spark, d, "tall"), ["type", "detector"], REPS), "lo", "hi")


@query("b2_paired_bootstrap", oracle(DELTAS + " SELECT type, rep, round(delta, 6) AS delta FROM de", "tall"))
def b2(spark, d):
    return rounded(resample.paired_bootstrap(view(spark, d, "tall"), "a", "b", ["type"], GATE_REPS), "delta")


@query("b3_gate_mean_diff", oracle(DELTAS + " SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, quantile_cont(m, 0.025) > 0 AS passed FROM (SELECT rep, avg(delta) AS m FROM de GROUP BY rep) q", "tall"))
def b3(spark, d):
    return rounded(resample.gate_mean_diff(resample.paired_bootstrap(view(spark, d, "tall"), "a", "b", ["type"], GATE_REPS)), "mean", "lo", "hi")


#: Three kinds by three severities; each cell's baseline is chosen on the even runs, the gate is held on the odd ones.
FAMILY = ", t3 AS (SELECT sim, type, sev, label, detector, score FROM tall UNION ALL SELECT sim, type, sev, label, 'c', k*25e-2 + (k*7) % 13 FROM records), vs AS (SELECT * FROM t3 WHERE sim % 2 = 0), tt AS (SELECT * FROM t3 WHERE sim % 2 = 1 AND type IN ('hourglass', 'inversion', 'frozen'))"
FAMILY += f", bl AS (SELECT type, sev, detector FROM (SELECT type, sev, detector, row_number() OVER (PARTITION BY type, sev ORDER BY round(auroc, 4) DESC, detector) AS r FROM ({ranked('vs', 'type, sev, detector')}) a WHERE detector IN ('b', 'c') AND auroc IS NOT NULL) q WHERE r = 1), us AS (SELECT t.sim, t.label, t.score, t.type || t.sev AS type, CASE WHEN t.detector = 'a' THEN 'a' ELSE 'b' END AS detector FROM tt t JOIN bl ON t.type = bl.type AND t.sev = bl.sev WHERE t.detector = 'a' OR t.detector = bl.detector)"
FAMILY += DELTAS.replace("FROM tall JOIN wt ON tall.sim = wt.sim", "FROM us JOIN wt ON us.sim = wt.sim").replace("FROM tall", "FROM tt")


@query("b3_family_gate", oracle(FAMILY + " SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, quantile_cont(m, 0.025) > 0 AS passed FROM (SELECT rep, avg(delta) AS m FROM de GROUP BY rep) q", "tall"))
def b3_family(spark, d):
    third = view(spark, d, "records").select("sim", "frame", "type", "sev", "label", "phase", F.lit("c").alias("detector"), F.expr("k*25e-2 + (k*7) % 13").alias("score"))
    every = view(spark, d, "tall").unionByName(third)
    cells = metrics.auroc(every.where("sim % 2 = 0"), ["type", "sev", "detector"]).withColumn("cell_phase", F.lit("all"))
    best = metrics.best_baselines(cells, ["b", "c"])
    test = every.where("sim % 2 = 1 and type in ('hourglass', 'inversion', 'frozen')")
    return rounded(resample.gate_mean_diff(resample.family_deltas(test, "a", best, ["type", "sev"], GATE_REPS)), "mean", "lo", "hi")


PVALUES = DELTAS + ", pv AS (SELECT type, (count(CASE WHEN delta - 33e-2 <= 0 THEN 1 END) + 1e0) / (count(*) + 1) AS p FROM de GROUP BY type)"


@query("b4_one_sided_p", oracle(PVALUES + " SELECT type, round(p, 6) AS p FROM pv", "tall"))
def b4(spark, d):
    deltas = resample.paired_bootstrap(view(spark, d, "tall"), "a", "b", ["type"], GATE_REPS).withColumn("delta", F.col("delta") - 0.33)
    return rounded(resample.one_sided_p(deltas, ["type"]), "p")


@query("b5_holm", oracle(PVALUES + " SELECT type, round(p, 6) AS p, min(ok) OVER (ORDER BY p, type ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM (SELECT type, p, CASE WHEN p <= 5e-2 / (count(*) OVER () - row_number() OVER (ORDER BY p, type) + 1) THEN 1 ELSE 0 END AS ok FROM pv) q", "tall"))
def b5(spark, d):
    deltas = resample.paired_bootstrap(view(spark, d, "tall"), "a", "b", ["type"], GATE_REPS).withColumn("delta", F.col("delta") - 0.33)
    return rounded(resample.holm(resample.one_sided_p(deltas, ["type"]), ["type"]), "p")


RUNBOOT = WEIGHTS.replace(f"range({REPS})", f"range({GATE_REPS})").replace("tall", "rr").replace(", cl AS", ", rr AS (SELECT sim, label, max(score_a) AS score FROM records GROUP BY sim, label), rq AS (SELECT 1 AS one, * FROM rr), cl AS", 1) + ", ag AS (SELECT rep, score, sum(CASE WHEN label THEN weight ELSE 0 END) AS p, sum(CASE WHEN label THEN 0 ELSE weight END) AS n FROM rr JOIN wt ON rr.sim = wt.sim GROUP BY ALL), un AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM ag)"
RUNREPS = "SELECT rep, sum(p*(u + n/2e0)) / (sum(p)*1e0*sum(n)) AS auroc FROM un GROUP BY rep"


@query("b6_run_auroc", oracle(RUNBOOT + f" SELECT rep, round(auroc, 6) AS auroc FROM ({RUNREPS}) q", "records"))
def b6(spark, d):
    runs = view(spark, d, "records").groupBy("sim", "label").agg(F.max("score_a").alias("score"))
    return rounded(resample.weighted_auroc(runs, resample.resamples(runs, GATE_REPS), [], GATE_REPS), "auroc")


@query("b6_run_auroc_ci", oracle(RUNBOOT + f", ba AS ({RUNREPS}) SELECT (SELECT round(auroc, 6) FROM ({ranked('rq', 'one')}) z) AS auroc, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi FROM ba", "records"))
def b6b(spark, d):
    runs = view(spark, d, "records").groupBy("sim", "label").agg(F.max("score_a").alias("score"))
    return rounded(resample.run_auroc(runs, [], GATE_REPS), "auroc", "lo", "hi")


@query("b7_median_ci", oracle(WEIGHTS.replace(f"range({REPS})", f"range({MEDIAN_REPS})") + ", mm AS (SELECT rep, quantile_cont(v, 0.5) AS m FROM (SELECT rep, unnest(list_transform(range(weight), lambda x: v)) AS v FROM wt JOIN (SELECT sim, max(score) AS v FROM tall GROUP BY sim) s ON wt.sim = s.sim) q GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM mm", "tall"))
def b7(spark, d):
    runs = view(spark, d, "tall").groupBy("sim").agg(F.max("score").alias("v"))
    return rounded(resample.median_ci(runs, "v", "sim", MEDIAN_REPS), "lo", "hi")


TERMS = ", tm AS (SELECT doc_id, list_filter([" + ", ".join(f"'{s}'" for s in STEMS) + "], lambda s: contains(lower(coalesce(text, '')), s)) AS t FROM documents), tp AS (SELECT a.doc_id AS item, a.t AS a, b.t AS b FROM tm a JOIN tm b ON b.doc_id = a.doc_id + 1)"
JACC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1e0 ELSE len(list_intersect({0}, {1}))*1e0/len(list_distinct(list_concat({0}, {1}))) END"


def _term_pairs(spark, d) -> DataFrame:
    t = view(spark, d, "documents").select("doc_id", terms(F.col("text"), STEMS).alias("t"))
    return t.select(F.col("doc_id").alias("item"), F.col("t").alias("a")).join(t.select((F.col("doc_id") - 1).alias("item"), F.col("t").alias("b")), "item")


@query("x2_terms", "WITH x AS (SELECT 1)" + TERMS + " SELECT doc_id, array_to_string(t, ',') AS terms FROM tm")
def x2(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(terms(F.col("text"), STEMS), ",").alias("terms"))


@query("x3_jaccard", "WITH x AS (SELECT 1)" + TERMS + f" SELECT item, round({JACC.format('a', 'b')}, 6) AS similarity FROM tp")
def x3(spark, d):
    return rounded(_term_pairs(spark, d).select("item", jaccard(F.col("a"), F.col("b")).alias("similarity")), "similarity")


@query("b8_permutation_p", "WITH x AS (SELECT 1)" + TERMS + f", nu AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('0|order|' || CAST(item AS VARCHAR)), 1, 8))::BIGINT, item) AS i FROM tp), re AS (SELECT nu.*, rep FROM nu, (SELECT unnest(range({PERMUTATIONS})) AS rep) r), sh AS (SELECT rep, b, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('0|' || CAST(rep AS VARCHAR) || '|' || CAST(item AS VARCHAR)), 1, 8))::BIGINT, item) AS i FROM re), me AS (SELECT re.rep, avg({JACC.format('re.a', 'sh.b')}) AS m FROM re JOIN sh ON re.rep = sh.rep AND re.i = sh.i GROUP BY re.rep), ob AS (SELECT avg({JACC.format('a', 'b')}) AS observed FROM nu) SELECT round(observed, 6) AS observed, round((count(CASE WHEN m >= observed THEN 1 END) + 1e0)/(count(*) + 1), 6) AS p FROM me, ob GROUP BY observed")
def b8(spark, d):
    return rounded(resample.permutation_p(_term_pairs(spark, d), jaccard, PERMUTATIONS), "observed", "p")


@query("b8_multiset_permutation_p")
def b8_multiset(spark, d):
    return rounded(resample.multiset_permutation_p(_term_pairs(spark, d), jaccard, PERMUTATIONS), "observed", "p")


@query("l1_conformal_threshold", oracle(", mx AS (SELECT sim, detector, max(score) AS run_max FROM tall WHERE frame >= 10 GROUP BY sim, detector) SELECT detector, round(max(CASE WHEN r = ceil((n+1)*9e-1) THEN run_max END), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY run_max, sim) AS r, count(*) OVER (PARTITION BY detector) AS n FROM mx) q GROUP BY detector", "tall"))
def l1(spark, d):
    return rounded(alarms.conformal_threshold(alarms.run_max(view(spark, d, "tall"), 10), 0.1), "threshold")


@query("l2_run_max", oracle(" SELECT sim, detector, max(score) AS run_max FROM tall WHERE frame >= 10 GROUP BY sim, detector", "tall"))
def l2(spark, d):
    return alarms.run_max(view(spark, d, "tall"), 10)


ALARM = ", th AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM tall WHERE NOT label GROUP BY detector)"


@query("j13_alarms", oracle(ALARM + " SELECT sim, frame, detector, score FROM tall JOIN th USING (detector) WHERE score > threshold", "tall"))
def j13(spark, d):
    t = view(spark, d, "tall")
    thresholds = detect.clean_level(t.where("not label"), keys=["detector"]).withColumnRenamed("level", "threshold")
    return alarms.alarms(t, thresholds).select("sim", "frame", "detector", "score")


@query("c5_clean_level", oracle(" SELECT detector, round(quantile_cont(score, 0.95), 6) AS level FROM tall WHERE NOT label GROUP BY detector", "tall"))
def c5(spark, d):
    return rounded(detect.clean_level(view(spark, d, "tall").where("not label"), keys=["detector"]), "level")


@query("l7_run_fpr", oracle(ALARM + ", mx AS (SELECT sim, detector, max(score) AS run_max FROM tall WHERE frame >= 10 GROUP BY sim, detector) SELECT detector, round(avg(CASE WHEN run_max > threshold THEN 1e0 ELSE 0e0 END), 6) AS false_alarm_rate FROM mx JOIN th USING (detector) GROUP BY detector", "tall"))
def l7(spark, d):
    t = view(spark, d, "tall")
    thresholds = detect.clean_level(t.where("not label"), keys=["detector"]).withColumnRenamed("level", "threshold")
    return rounded(alarms.run_fpr(alarms.run_max(t, 10), thresholds), "false_alarm_rate")


@query("p11_log1p_features", oracle(" SELECT sim, frame, round(ln(1 + abs(score_a)), 6) AS a, round(ln(1 + abs(score_b)), 6) AS b FROM records", "records"))
def p11(spark, d):
    return rounded(view(spark, d, "records").select("sim", "frame", log1p_abs(F.col("score_a")).alias("a"), log1p_abs(F.col("score_b")).alias("b")), "a", "b")


@query("p12_softmax", oracle(" SELECT sim, frame, round(greatest(1/(1 + exp((score_b - score_a)/20e0)), 1e-12), 6) AS pa, round(greatest(1/(1 + exp((score_a - score_b)/20e0)), 1e-12), 6) AS pb FROM records", "records"))
def p12(spark, d):
    s = view(spark, d, "records").select("sim", "frame", softmax(F.array("score_a", "score_b"), 20.0).alias("p"))
    return rounded(s.select("sim", "frame", F.col("p")[0].alias("pa"), F.col("p")[1].alias("pb")), "pa", "pb")


@query("t1_triage_features", oracle(" SELECT sim, frame, sev, CASE WHEN label THEN type ELSE 'none' END AS kind, round(ln(1 + abs(score_a)), 6) AS a, round(ln(1 + abs(score_b)), 6) AS b FROM records", "records"))
def t1(spark, d):
    return rounded(answers.triage_features(view(spark, d, "tall"), ["a", "b"]), "a", "b")


EMB = ", u AS (SELECT vec_id, label, item, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y*y)))) AS e FROM unit)"


@query("d11_zero_shot", oracle(EMB + ", m AS (SELECT label AS state, i, avg(e[i]) AS v FROM u, (SELECT unnest(range(1, 65)) AS i) r WHERE label IN (0, 1) GROUP BY ALL), c AS (SELECT state, list(v ORDER BY i) AS c FROM m GROUP BY state), n AS (SELECT state, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y*y)))) AS c FROM c), s AS (SELECT vec_id, item, list_dot_product(e, (SELECT c FROM n WHERE state = 0)) AS a, list_dot_product(e, (SELECT c FROM n WHERE state = 1)) AS b FROM u) SELECT vec_id, item, round(1/(1 + exp((a-b)/1e-2)), 5) AS score, round(b - a, 5) AS difference FROM s", "unit"))
def d11(spark, d):
    e = view(spark, d, "unit")
    return rounded(answers.zero_shot_scores(e, e.where("label in (0, 1)").select(F.col("label").alias("state"), "embedding")), "score", "difference", digits=5)


@query("d12_patch_knn", oracle(EMB + ", n AS (SELECT q.vec_id, q.item, 1 - max(list_dot_product(q.e, b.e)) AS d FROM u q, u b WHERE q.vec_id % 5 <> 0 AND b.vec_id % 5 = 0 GROUP BY ALL) SELECT item, round(max(d), 5) AS score FROM n GROUP BY item", "unit"))
def d12(spark, d):
    e = view(spark, d, "unit")
    return rounded(answers.patch_knn(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")), "score", digits=5)


@query("d14_bundle_score", oracle(", st AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) + 1e-9 AS s FROM unit, (SELECT unnest(range(1, 65)) AS i) r WHERE vec_id % 5 = 0 GROUP BY i), z AS (SELECT vec_id, list((embedding[i]::DOUBLE - m)/s ORDER BY i) AS e FROM unit, st GROUP BY vec_id), k AS (SELECT q.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, b.e), lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS d FROM z q, z b WHERE q.vec_id % 5 <> 0 AND b.vec_id % 5 = 0), r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM k) SELECT vec_id, round(avg(d), 5) AS score FROM r WHERE n <= 5 GROUP BY vec_id", "unit"))
def d14(spark, d):
    e = view(spark, d, "unit").select("vec_id", "embedding")
    return rounded(answers.bundle_score(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")), "score", digits=5)


@query("s6_pending_jobs", oracle(" SELECT sim, frame FROM records WHERE k >= 10", "records"))
def s6(spark, d):
    from trajscreen.sources.tables import pending

    r = view(spark, d, "records")
    return pending(r.select("sim", "frame"), r.where("k < 10").select("sim", "frame"), ["sim", "frame"])
