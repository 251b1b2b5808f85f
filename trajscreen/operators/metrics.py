"""Metrics over records (sim, frame, type, sev, label, phase, detector, score): ranking quality, tables, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import median
from trajscreen.functions.lineage import cut


def auroc(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """(keys, auroc): area under the ROC curve, ties counted half; null where a class is missing. Rows are first counted by score.
    Distinct scores of all groups together are dealt over ranges of (keys, score), however many one group has; a range adds up
    its own pairs, and the pairs between ranges follow from the negatives of the group's ranges before it."""
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("int")).alias("pos"), F.sum((~F.col(label)).cast("int")).alias("neg"))
    ranged = counts.repartitionByRange(*keys, score).withColumn("__range", F.spark_partition_id())
    below = Window.partitionBy(*keys, "__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    parts = ranked.groupBy(*keys, "__range").agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = parts.withColumn("before", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    won = F.sum(F.col("won") + F.col("pos").cast("double") * F.col("before"))
    return carried.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auroc"))


GRID = 512  # points of a group's sketch


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """(keys, name): exact quantile, interpolated, of the values that aren't null, for groups of any size.

    A sketch of GRID points a group, ten times as exact as its points are apart, brackets the two values between which the
    quantile lies. One more pass counts what lies below the bracket and collects the values within it, about 3 in GRID of the
    group; these are dealt over ranges of (keys, value), numbered within their range after the counts of the ranges before,
    and the two of the wanted numbers picked. No task reads a whole group, and no group's values are held in a buffer."""
    by = [*keys, "__all"]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__all"))
    points = F.array(*[F.lit(i / GRID) for i in range(1, GRID + 1)])
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", points, 10 * GRID).alias("__grid"))
    place = (F.col("__n") - 1) * F.lit(q)
    low = F.floor(place)
    high = F.ceil(place)
    point = lambda i: F.when((i >= 1) & (i <= GRID), F.get("__grid", (i - 1).cast("int")))
    first, last = F.floor(low / F.col("__n") * GRID) - 1, F.ceil((high + 1) / F.col("__n") * GRID) + 1
    wanted = cut(sketch.select(*by, place.alias("__place"), low.alias("__low"), high.alias("__high"), point(first).alias("__from"), point(last).alias("__to")))
    near = null_free(rows, wanted, by).where(F.col("__to").isNull() | (F.col("__v") <= F.col("__to")))
    within = F.when(F.col("__from").isNull() | (F.col("__v") >= F.col("__from")), F.col("__v"))
    counts = near.groupBy(*by, within.alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    ranged = cut(counts.repartitionByRange(*by, "__v").withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy(*by, "__range").agg(F.sum("__m").alias("__s")).select(*by, "__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    own = F.sum("__m").over(Window.partitionBy(*by, "__range").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = null_free(null_free(ranged.withColumn("__own", own), starts, [*by, "__range"]), wanted, by).withColumn("__end", F.col("__start") + F.col("__own"))
    at = lambda k: F.max(F.when((F.col(k) < F.col("__end")) & (F.col(k) >= F.col("__end") - F.col("__m")), F.col("__v")))
    found = placed.groupBy(*by, "__place", "__low", "__high").agg(at("__low").alias("__a"), at("__high").alias("__b"))
    between = (F.col("__low") + 1 - F.col("__place")) * F.col("__a") + (F.col("__place") - F.col("__low")) * F.col("__b")
    return found.select(*keys, F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("the sketch missed its bracket")).cast("double")).when(F.col("__low") == F.col("__high"), F.col("__a")).otherwise(between).alias(name))


def null_free(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join on keys where null equals null."""
    named = right.select(*[F.col(c).alias(f"__right_{c}") if c in on else F.col(c) for c in right.columns])
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__right_{c}"))
        same = one if same is None else same & one
    return left.join(named, same).drop(*[f"__right_{c}" for c in on])


def node_auroc(scores: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over frames of the AUROC of node scores against a node mask (sim, frame, node)."""
    marked = scores.join(masks.select("sim", "frame", "node", F.lit(True).alias("label")), ["sim", "frame", "node"], "left").fillna(False, ["label"])
    return auroc(marked, ["sim", "frame", *[k for k in keys if k not in ("sim", "frame")]]).where("auroc is not null").groupBy(*keys).agg(F.avg("auroc").alias("node_auroc"))


def tpr_at_fpr(df: DataFrame, keys: Sequence[str], fpr: float = 0.05) -> DataFrame:
    """(keys, tpr): share of positives strictly above the negatives' 1 - fpr quantile."""
    threshold = quantile(df.where("not label"), keys, "score", 1 - fpr, "threshold")
    return df.where("label").join(threshold, list(keys)).groupBy(*keys).agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("tpr"))


def by_phase(records: DataFrame) -> DataFrame:
    """Records once for each phase of report they count in: clean ones in all, others in 'all' and their own."""
    phases = F.when(F.col("phase") == "clean", F.array(F.lit("all"), F.lit("onset"), F.lit("sustained"))).otherwise(F.array(F.lit("all"), F.col("phase")))
    return records.withColumn("cell_phase", F.explode(phases))


def cell_metrics(records: DataFrame) -> DataFrame:
    """(type, sev, cell_phase, detector, auroc, tpr) of cells with both classes."""
    keys = ["type", "sev", "cell_phase", "detector"]
    cells = by_phase(records)
    return auroc(cells, keys).where("auroc is not null").join(tpr_at_fpr(cells, keys), keys)


def known_cell_metrics(records: DataFrame, types: Sequence[str], severities: Sequence[int], detectors: Sequence[str]) -> DataFrame:
    """cell_metrics where the types, severities and detectors are known: records move with their cell's number in place of its keys."""
    known = {"type": list(types), "sev": list(severities), "cell_phase": ["all", "onset", "sustained"], "detector": list(detectors)}
    array = lambda c: F.array(*[F.lit(x) for x in known[c]])
    cell = F.lit(0)
    for c in known:
        place = F.array_position(array(c), F.col(c))
        cell = cell * len(known[c]) + F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit(f"no known {c}: "), F.col(c).cast("string"))).cast("int"))
    numbered = by_phase(records).select(cell.cast("int").alias("cell"), "label", "score")
    found = auroc(numbered, ["cell"]).where("auroc is not null").join(tpr_at_fpr(numbered, ["cell"]), "cell")
    for c in reversed(known):
        found = found.withColumn(c, F.get(array(c), F.pmod("cell", F.lit(len(known[c]))))).withColumn("cell", F.floor(F.col("cell") / len(known[c])).cast("int"))
    return found.select(*known, "auroc", "tpr")


def phase_table(metrics: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """(type, cell_phase, one column a detector): mean AUROC over severities."""
    return metrics.groupBy("type", "cell_phase").pivot("detector", list(detectors)).agg(F.avg("auroc"))


def best_baselines(metrics: DataFrame, pool: Sequence[str], phase: str = "all", digits: int | None = 4) -> DataFrame:
    """(type, sev, detector, auroc): the pool's best in each cell, the first of equals in pool order."""
    order = F.array_position(F.array(*[F.lit(p) for p in pool]), F.col("detector"))
    own = metrics.where(F.col("detector").isin(list(pool)) & (F.col("cell_phase") == phase) & F.col("auroc").isNotNull())
    own = own.withColumn("auroc", F.round("auroc", digits)) if digits is not None else own
    rank = F.row_number().over(Window.partitionBy("type", "sev").orderBy(F.desc("auroc"), order))
    return own.withColumn("r", rank).where("r = 1").select("type", "sev", "detector", "auroc")


def rmse_vs_baseline(df: DataFrame, prediction: str, target: str, mask: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rmse, baseline, ratio, admitted): root mean square error and that of predicting 0 on masked rows; admitted
    if at most half of it."""
    own = df.where(F.col(mask))
    e = F.col(prediction) - F.col(target)
    out = own.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(F.col(target) * F.col(target))).alias("baseline"))
    return out.withColumn("ratio", F.col("rmse") / F.col("baseline")).withColumn("admitted", F.col("rmse") <= 0.5 * F.col("baseline"))


def confusion(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(truth, one count column a label and one for invalid)."""
    return df.withColumn("pred", F.coalesce("pred", F.lit("invalid"))).groupBy("truth").pivot("pred", [*labels, "invalid"]).count().fillna(0)


def score_answers(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """By arm: accuracy, macro-F1 over the labels (0 where undefined), share of valid answers, location accuracy; where df has a
    column flagged also flagged_accuracy, that of the rows it marks (null without any), and n_flagged."""
    right = (F.col("pred") == F.col("truth")) & F.col("pred").isNotNull()
    hit = F.coalesce(right, F.lit(False)).cast("double")
    marked = [F.avg(F.when(F.col("flagged"), hit)).alias("flagged_accuracy"), F.count_if("flagged").alias("n_flagged")] if "flagged" in df.columns else []
    base = df.groupBy("arm").agg(F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"), F.avg(F.col("pred").isNotNull().cast("double")).alias("valid_rate"), F.avg(F.coalesce(F.col("location") == F.col("truth_location"), F.lit(False)).cast("double")).alias("location_accuracy"), *marked)
    spread = df.select("arm", "truth", F.coalesce("pred", F.lit("invalid")).alias("pred"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    count = lambda c: F.sum(c.cast("int"))
    is_truth, is_pred = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    f1 = spread.groupBy("arm", "label").agg(count(is_truth & is_pred).alias("tp"), count(is_truth).alias("t"), count(is_pred).alias("p"))
    f1 = f1.groupBy("arm").agg(F.avg(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)).alias("macro_f1"))
    return base.join(f1, "arm")


def majority_baseline(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, share): the commonest value, the smallest of equals."""
    counts = df.groupBy(*keys, F.col(column).alias("value")).count()
    window = Window.partitionBy(*keys)
    rank = F.row_number().over(window.orderBy(F.desc("count"), "value"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(window)).withColumn("r", rank).where("r = 1").select(*keys, "value", "share")


def ece(df: DataFrame, bins: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ece): expected calibration error over equal bins of conf; the top edge falls in the last one."""
    binned = df.withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    parts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"), F.avg("conf").alias("mean_conf"))
    return parts.groupBy(*keys).agg((F.sum(F.abs(F.col("acc") - F.col("mean_conf")) * F.col("n")) / F.sum("n")).alias("ece"))


def brier_multiclass(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, brier): mean over rows of the squared distance of probs (array) from the truth (truth_index, from 0; null if
    it isn't among the classes)."""
    square = F.aggregate(F.transform("probs", lambda p, i: (p - (i == F.coalesce(F.col("truth_index"), F.lit(-1))).cast("double")) * (p - (i == F.coalesce(F.col("truth_index"), F.lit(-1))).cast("double"))), F.lit(0.0), lambda t, x: t + x)
    return df.groupBy(*keys).agg(F.avg(square).alias("brier"))


def macro_f1(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, macro_f1): mean over labels of F1 from truth and pred, 0 where undefined."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    sums = [(count((F.col("truth") == x) & (F.col("pred") == x)), count(F.col("truth") == x) + count(F.col("pred") == x)) for x in labels]
    parts = [F.coalesce(F.try_divide(2.0 * hit, both.cast("double")), F.lit(0.0)) for hit, both in sums]
    return df.groupBy(*keys).agg((sum(parts[1:], parts[0]) / len(labels)).alias("macro_f1"))


def brier(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, brier): mean squared difference of conf and correct."""
    d = F.col("conf") - F.col("correct")
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier"))


def gate_mean(metrics: DataFrame, threshold: float = 0.8, severity: int = 3) -> DataFrame:
    """(detector, mean_auroc, passed) at one severity."""
    return metrics.where(F.col("sev") == severity).groupBy("detector").agg(F.avg("auroc").alias("mean_auroc")).withColumn("passed", F.col("mean_auroc") >= threshold)


def selective(df: DataFrame, coverage: float = 0.8, target: float = 0.95) -> DataFrame:
    """One row: accuracy at a coverage, the largest coverage whose cumulative accuracy reaches the target, and the
    confidence there (1 if none). df: item, conf, correct; equal confidences by item. Cumulative sums run within ranges
    of confidence and add up the ranges before, so no task orders all rows."""
    ranges = 1024
    placed = df.withColumn("b", F.least(F.floor((1 - F.col("conf")) * ranges), F.lit(ranges - 1)))
    counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # `ranges` rows at most
    starts = counts.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    order = Window.partitionBy("b").orderBy(F.desc("conf"), "item")
    own = placed.withColumn("n1", F.row_number().over(order)).withColumn("c1", F.sum("correct").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(starts, "b")
    own = own.select("conf", (F.col("n0") + F.col("n1")).alias("k"), ((F.col("c0") + F.col("c1")) / (F.col("n0") + F.col("n1"))).alias("cum"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = own.withColumn("n", total)
    best = F.max(F.when(F.col("cum") >= target, F.struct("k", "conf")))
    return own.groupBy("n").agg(F.max(F.when(F.col("k") == F.floor(F.col("n") * coverage), F.col("cum"))).alias("acc_at_coverage"), best.alias("b")).select("acc_at_coverage", F.coalesce(F.col("b.k") / F.col("n"), F.lit(0.0)).alias("coverage"), F.coalesce(F.col("b.conf"), F.lit(1.0)).alias("tau"))


def fit_tau(df: DataFrame, target: float = 0.95) -> float:
    """The confidence at the last row, by falling confidence, at which cumulative accuracy reaches the target; 1 if none does."""
    return selective(df, target=target).first()["tau"]


def abstain_rate(df: DataFrame, tau: float) -> DataFrame:
    return df.agg(F.avg((F.col("conf") < tau).cast("double")).alias("abstain_rate"))


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, draw: Column, order: Sequence[str]) -> DataFrame:
    """Up to n rows of each stratum, by a drawn number and then `order`."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, *order))
    return df.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def median_shift(shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return shifts.groupBy(*keys).agg(median(F.col("shift")).alias("median_shift"))


def assert_labels_agree(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sim", "type", "sev", "frame")) -> None:
    """Raises if a row that both have is labelled differently."""
    other = b.select(*keys, F.col("label").alias("other"))
    if not a.join(other, list(keys)).where(~F.col("label").eqNullSafe(F.col("other"))).isEmpty():
        raise ValueError("the records disagree on labels")


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sim", "type", "sev", "frame")) -> DataFrame:
    """Two detectors' scores on the rows that both have: keys, label, score_x, score_y."""
    return a.select(*keys, "label", F.col("score").alias("score_x")).join(b.select(*keys, F.col("score").alias("score_y")), list(keys))


FAMILIES: Mapping[str, tuple[str, ...]] = {"local": ("hourglass", "penetration", "inversion"), "late": ("instability", "frozen")}
