"""Alarms, lead times, conformal thresholds, and run-level statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import median
from trajscreen.functions.lineage import cut
from trajscreen.operators.resample import grouped_median_ci, holm, one_sided_p, resamples, weighted_auroc
from trajscreen.operators.metrics import auroc, quantile, rmse_vs_baseline

MAD = 1.4826


def run_max(scores: DataFrame, burn_in: int = 40) -> DataFrame:
    """(sim, detector, run_max) over frames from burn_in on."""
    return scores.where(F.col("frame") >= burn_in).groupBy("sim", "detector").agg(F.max("score").alias("run_max"))


def conformal_threshold(maxima: DataFrame, alpha: float) -> DataFrame:
    """(detector, threshold): the ceil((n + 1)(1 - alpha))-th smallest clean-run maximum, infinity beyond n."""
    window = Window.partitionBy("detector")
    k = F.ceil((F.count(F.lit(1)).over(window) + 1) * F.lit(1 - alpha))
    ranked = maxima.withColumn("k", k).withColumn("r", F.row_number().over(window.orderBy("run_max", "sim")))
    return ranked.groupBy("detector").agg(F.coalesce(F.max(F.when(F.col("r") == F.col("k"), F.col("run_max"))), F.lit(float("inf"))).alias("threshold"))


def alarms(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores strictly above their detector's threshold."""
    return scores.join(thresholds, "detector").where(F.col("score") > F.col("threshold")).drop("threshold")


def run_fpr(maxima: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(detector, false_alarm_rate) over clean runs."""
    return maxima.join(thresholds, "detector").groupBy("detector").agg(F.avg((F.col("run_max") > F.col("threshold")).cast("double")).alias("false_alarm_rate"))


def frame_threshold(scores: DataFrame, events: DataFrame, q: float = 0.95, gap: int = 3) -> DataFrame:
    """(detector, threshold): quantile of the scores of frames before t0 - gap."""
    before = scores.join(events.select("sim", "t0"), "sim").where(F.col("frame") < F.col("t0") - gap)
    return quantile(before, ["detector"], "score", q, "threshold")


def event_bounds(deviations: DataFrame, share: float = 0.999, before: int = 15, least: int = 2) -> DataFrame:
    """(sim, kind, t0, end, start) from (sim, kind, frame, deviation): t0 is the first deviating frame; end the first frame at
    `share` of the largest deviation for a blow-up, the last deviating frame otherwise; frames from start (`before` frames
    before t0, but `least` at least) to end are scored."""
    off = deviations.where("deviation > 0").withColumn("most", F.max("deviation").over(Window.partitionBy("sim", "kind")))
    reached = F.min(F.when(F.col("deviation") >= share * F.col("most"), F.col("frame")))
    found = off.groupBy("sim", "kind").agg(F.min("frame").alias("t0"), reached.alias("top"), F.max("frame").alias("last"))
    return found.select("sim", "kind", "t0", F.when(F.col("kind") == "blowup", F.col("top")).otherwise(F.col("last")).alias("end"), F.greatest(F.col("t0") - before, F.lit(least)).alias("start"))


def scored_window(scores: DataFrame, events: DataFrame) -> DataFrame:
    """Scores of the frames from start to end of their run's event, with the event's columns."""
    return scores.join(events, "sim").where((F.col("frame") >= F.col("start")) & (F.col("frame") <= F.col("end")))


def lead_times(scores: DataFrame, events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(sim, kind, detector, first, lead): the first alarm from t0 to end; lead = end - first for a blow-up, first - t0 (a
    latency) otherwise; null where there is no alarm in time."""
    detectors = thresholds.select("detector", "threshold")
    within = scores.join(events, "sim").where((F.col("frame") >= F.col("t0")) & (F.col("frame") <= F.col("end"))).join(detectors, "detector")
    first = within.groupBy("sim", "kind", "t0", "end", "detector").agg(F.min(F.when(F.col("score") > F.col("threshold"), F.col("frame"))).alias("first"))
    return first.select("sim", "kind", "detector", "first", F.when(F.col("kind") == "blowup", F.col("end") - F.col("first")).otherwise(F.col("first") - F.col("t0")).alias("lead"))


def lead_summary(scores: DataFrame, events: DataFrame, thresholds: DataFrame, reps: int = 1000, gap: int = 3) -> DataFrame:
    """(kind, detector, n, detected, median_lead, lo, hi, false_alarm_rate): the median and its bootstrap interval are over
    events with an alarm; false alarms are those of the scored frames before t0 - gap."""
    keys = ["kind", "detector"]
    leads = lead_times(scores, events, thresholds)
    out = leads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("first").isNotNull().cast("double")).alias("detected"), median(F.col("lead")).alias("median_lead"))
    ci = grouped_median_ci(leads.where("lead is not null"), keys, "lead", "sim", reps)
    early = scored_window(scores, events).where(F.col("frame") < F.col("t0") - gap).join(thresholds, "detector")
    false = early.groupBy(*keys).agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("false_alarm_rate"))
    return out.join(ci, keys, "left").join(false, keys, "left").fillna(0.0, ["false_alarm_rate"])


def run_stats(frames: DataFrame, steps: DataFrame, undivided: Sequence[str] = ("velocity",)) -> DataFrame:
    """(sim, detector, value): median frame score of a run by its own step scale."""
    mid = frames.groupBy("sim", "detector").agg(median(F.col("score")).alias("m")).join(steps, "sim")
    return mid.select("sim", "detector", F.when(F.col("detector").isin(list(undivided)), F.col("m")).otherwise(F.col("m") / F.col("step")).alias("value"))


def contact_run_stats(gaps: DataFrame, steps: DataFrame, keys: Sequence[str] = ("sim",)) -> DataFrame:
    """(keys, contact_gap, contact_depth) from signed distances (keys, frame, gap) by the actuator's step. keys: what a run is."""
    return gaps.groupBy(*keys).agg(median(F.col("gap")).alias("g"), F.max(F.greatest(F.lit(0.0), -F.col("gap"))).alias("d")).join(steps, list(keys)).select(*keys, (F.col("g") / F.col("step")).alias("contact_gap"), (F.col("d") / F.col("step")).alias("contact_depth"))


def shape_run_stats(observed: DataFrame, predicted: DataFrame, on: Sequence[str], keys: Sequence[str] = ("sim",)) -> DataFrame:
    """(keys, shape_scale, shape_resid) of displacements against predicted ones. keys: what a run is."""
    p = predicted.select(*on, *[F.col(c).alias(f"p{c}") for c in ("ux", "uy", "uz")])
    both = observed.join(p, list(on))
    dot = sum((F.col(c) * F.col(f"p{c}") for c in ("ux", "uy", "uz")), F.lit(0.0))
    own = sum((F.col(f"p{c}") * F.col(f"p{c}") for c in ("ux", "uy", "uz")), F.lit(0.0))
    off = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in ("ux", "uy", "uz")), F.lit(0.0))
    return both.groupBy(*keys).agg(F.sum(dot).alias("d"), F.sum(own).alias("o"), F.sum(off).alias("r")).select(*keys, F.log(F.greatest(F.col("d") / F.col("o"), F.lit(1e-6))).alias("shape_scale"), F.sqrt(F.col("r") / F.col("o")).alias("shape_resid"))


def robust_z(rows: DataFrame, reference: DataFrame, keys: Sequence[str] = ("detector",)) -> DataFrame:
    """rows with z: distance from the reference median in scaled MADs."""
    centre = reference.groupBy(*keys).agg(median(F.col("value")).alias("med"))
    spread = reference.join(centre, list(keys)).groupBy(*keys, "med").agg(median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    return rows.join(spread, list(keys)).withColumn("z", F.abs(F.col("value") - F.col("med")) / (MAD * F.col("mad") + 1e-12)).drop("med", "mad")


def spread_table(clean: DataFrame, corrupted: DataFrame) -> DataFrame:
    """(detector, clean_cv, median_shift): variation over clean runs, and median over runs of how far a corrupted run lies
    from its own clean run, in MADs of the clean runs. clean_cv is 0 where the clean values are all 0."""
    base = clean.groupBy("detector").agg((F.stddev_pop("value") / (F.abs(F.avg("value")) + 1e-12)).alias("clean_cv"), median(F.col("value")).alias("med"))
    mad = clean.join(base, "detector").groupBy("detector", "clean_cv").agg(median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    pairs = corrupted.select("sim", "detector", F.col("value").alias("other")).join(clean, ["sim", "detector"])
    shift = pairs.groupBy("detector").agg(median(F.abs(F.col("other") - F.col("value"))).alias("s"))
    return mad.join(shift, "detector").select("detector", "clean_cv", (F.col("s") / (MAD * F.col("mad") + 1e-12)).alias("median_shift"))


def admitted(errors: DataFrame, statistics: Mapping[str, Sequence[str]]) -> list[str]:
    """The statistics of the surrogates that enter the gate: those whose root mean square error is at most half of that of predicting
    0. errors: (surrogate, prediction, target, mask), one row a predicted number; statistics: those that rest on each surrogate."""
    found = rmse_vs_baseline(errors, "prediction", "target", "mask", ["surrogate"]).where("admitted").select("surrogate").collect()  # one row a surrogate
    return [s for name in sorted(r["surrogate"] for r in found) for s in statistics.get(name, ())]


def gate_runs(runs: DataFrame, surrogates: Sequence[str], rules: Sequence[str], reps: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(kind, parameter, stat, rule, delta, lo, p, rejected, better, passed): each admitted surrogate statistic against the best
    rule statistic of its cell, by AUROC of z. runs: (sim, kind, parameter, detector, z), kind 'clean' for the clean run of a
    sim, which is compared with each corrupted one; a sim's runs are resampled together. delta is the difference of the
    points, lo its 2.5 % bound, p one-sided; better: rejected by Holm's procedure over all tests and delta above 0. passed:
    whether any test is better. Equal rules: the first in the given order."""
    cell = ["kind", "parameter"]
    own = runs.where(F.col("detector").isin([*surrogates, *rules]))
    clean = own.where("kind = 'clean'").select("sim", "detector", F.col("z").alias("score"))
    marked = own.where("kind <> 'clean'").select("sim", *cell, "detector", F.col("z").alias("score"), F.lit(True).alias("label"))
    both = cut(marked.unionByName(marked.select("sim", *cell, "detector").join(clean, ["sim", "detector"]).select("sim", *cell, "detector", "score", F.lit(False).alias("label"))))
    points = cut(auroc(both, [*cell, "detector"]).where("auroc is not null"))
    boots = cut(weighted_auroc(both, resamples(both, reps), [*cell, "detector"], reps))  # joined twice
    order = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("detector"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("auroc"), order))
    best = points.where(F.col("detector").isin(list(rules))).withColumn("r", rank).where("r = 1").select(*cell, F.col("detector").alias("rule"), F.col("auroc").alias("rule_auroc"))
    tests = points.where(F.col("detector").isin(list(surrogates))).withColumnRenamed("detector", "stat").join(best, cell)
    of_rule = boots.withColumnsRenamed({"detector": "rule", "auroc": "rule_boot"})
    deltas = tests.select(*cell, "stat", "rule").join(boots.withColumnRenamed("detector", "stat"), [*cell, "stat"]).join(of_rule, [*cell, "rule", "rep"]).withColumn("delta", F.col("auroc") - F.col("rule_boot"))
    bounds = deltas.groupBy(*cell, "stat").agg(F.percentile("delta", F.lit(0.025)).alias("lo"))
    out = tests.select(*cell, "stat", "rule", (F.col("auroc") - F.col("rule_auroc")).alias("delta")).join(bounds, [*cell, "stat"]).join(one_sided_p(deltas, [*cell, "stat"]), [*cell, "stat"])
    judged = holm(out, [*cell, "stat"], alpha).withColumn("better", F.col("rejected") & (F.col("delta") > 0))
    return judged.withColumn("passed", F.max("better").over(Window.partitionBy()))  # one row a test
