"""Scored text answers, embeddings against banks and text centroids, and classifier triage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.columns import dot, draw, log1p_abs, softmax, unit_vector
from trajscreen.functions.lineage import cut
from trajscreen.functions.workers import carried
from trajscreen.operators.boosting import Boosted, fit, with_logits
from trajscreen.operators.metrics import abstain_rate, brier_multiclass, ece, fit_tau, macro_f1, selective

carried(__name__)

ANSWER = "anomaly_type string, location string, confidence double, explanation string"
BLOCK = 20_000  # rows of a block of queries or of a shard of the bank
STEP = 256  # queries of a block that are held against a shard at once
BANKED = 4096  # rows of a bank whose distances are held at once
NEAR = "vec_id bigint, d double"
HELD = 32 << 20  # bytes of a bank that is sent to every task
PIVOTS = 256
RINGS = 8  # a cell's rows are cut by their distance to its pivot
SLACK = 1e-6  # rounding of distances, over the length of the vectors


def parse_answer(raw: Column, labels: Sequence[str]) -> Column:
    """The answer struct from the outermost braces of a text; null if it isn't JSON or its type is not a label."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), ANSWER)
    return F.when(parsed["anomaly_type"].isin(list(labels)), parsed)


def pair_metrics(pairs: DataFrame, none: str = "none", target: str = "hourglass") -> DataFrame:
    """By arm, from (arm, pred_a, pred_b, similarity): share of A answered none, of B answered target, of pairs told
    apart, and mean similarity."""
    a, b = F.coalesce("pred_a", F.lit("invalid")), F.coalesce("pred_b", F.lit("invalid"))
    share = lambda c: F.avg(c.cast("double"))
    return pairs.groupBy("arm").agg(share(a == none).alias("none_a"), share(b == target).alias("target_b"), share((a == none) & ~b.isin(none, "invalid")).alias("separated"), F.avg("similarity").alias("similarity"))


def pilot_report(rows: DataFrame, pairs: DataFrame, base: str, none: str = "none", gain: int = 5, apart: int = 3) -> DataFrame:
    """By arm, counts of answers (arm, truth, pred, truth_location, location; pred null where invalid) and of pairs (arm, pred_a,
    pred_b), and the decision: scale_up if the arm has `gain` more right types than the arm `base` on anomalous rows, or tells
    `apart` pairs apart."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    odd, called = F.col("truth") != none, F.col("pred") == none
    sums = {"type_right": odd & (F.col("pred") == F.col("truth")), "n_anomalous": odd, "none_on_anomalous": odd & called, "clean_called_none": ~odd & called, "n_clean": ~odd, "location_right": odd & F.col("pred").isNotNull() & (F.col("location") == F.col("truth_location")), "n_located": odd & F.col("pred").isNotNull(), "invalid": F.col("pred").isNull()}
    rates = rows.groupBy("arm").agg(*[count(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("n"))
    told = pairs.groupBy("arm").agg(count((F.col("pred_a") == none) & (F.col("pred_b") != none)).alias("separated"), F.count(F.lit(1)).alias("n_pairs"))
    reached = rates.where(F.col("arm") == base).agg(F.max("type_right").alias("b")).scalar()
    both = rates.join(told, "arm", "left").fillna(0, ["separated", "n_pairs"]).withColumn("base", reached)
    return both.withColumn("scale_up", (F.col("type_right") - F.col("base") >= gain) | (F.col("separated") >= apart)).drop("base")


def render_prompt(df: DataFrame, template: str, columns: Sequence[str], optional: str = r"[^.:;]*n/a[^.:;]*[.:;] ?") -> DataFrame:
    """df with prompt: the template filled in; a fragment with a missing value (null or NaN) is taken out by the pattern
    `optional`, as it has n/a there."""
    shown = [F.when(F.col(c).isNull() | (F.lower(F.col(c).cast("string")) == "nan"), F.lit("n/a")).otherwise(F.col(c).cast("string")) for c in columns]
    return df.withColumn("prompt", F.regexp_replace(F.format_string(template, *shown), optional, ""))


def zero_shot_scores(embeddings: DataFrame, texts: DataFrame, temperature: float = 0.01) -> DataFrame:
    """(item, vec_id, score, difference): softmax of the cosines to the two text centroids (state 0 normal, 1 anomalous),
    and their difference. Centroids are mean unit vectors, scaled to unit length: two rows."""
    means = texts.select("state", F.posexplode(unit_vector(F.col("embedding"))).alias("i", "v")).groupBy("state", "i").agg(F.avg("v").alias("v"))
    centroids = means.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    one = lambda k: centroids.where(F.col("state") == k).select(unit_vector(F.col("c")).alias("c")).scalar()
    withc = embeddings.withColumn("e", unit_vector(F.col("embedding"))).withColumn("c0", one(0)).withColumn("c1", one(1))
    cos = withc.select("item", "vec_id", dot(F.col("e"), F.col("c0")).alias("normal"), dot(F.col("e"), F.col("c1")).alias("odd"))
    return cos.select("item", "vec_id", (1 / (1 + F.exp((F.col("normal") - F.col("odd")) / temperature))).alias("score"), (F.col("odd") - F.col("normal")).alias("difference"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(q: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Between rows; by cosine both are of unit length."""
    return 1 - q @ b.T if cosine else np.sqrt(np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1) - 2 * q @ b.T, 0))


def _nearest(ids: np.ndarray, q: np.ndarray, b: np.ndarray, k: int, cosine: bool) -> pa.Table:
    """(vec_id, d): the k smallest distances of each row of q to the rows of b, `STEP` rows of q and `BANKED` of b at once."""
    out_ids, out = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(q) if len(b) else 0, STEP):
        some = q[at : at + STEP]
        best = np.zeros((len(some), 0))
        for of in range(0, len(b), BANKED):
            d = np.concatenate([best, _distances(some, b[of : of + BANKED], cosine)], axis=1)
            best = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        best = np.sort(best, axis=1)
        out_ids.append(np.repeat(ids[at : at + STEP], best.shape[1]))
        out.append(best.ravel())
    return pa.table({"vec_id": np.concatenate(out_ids), "d": np.concatenate(out)})


def _vectors(df: DataFrame, cosine: bool) -> DataFrame:
    """(vec_id, v) of rows with a vector, as doubles; by cosine of unit length, a zero vector as NaN, whose distances are NaN."""
    v = F.col("embedding").cast("array<double>")
    length = F.sqrt(dot(v, v))
    return df.where(F.col("embedding").isNotNull()).select("vec_id", (F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(float("nan")))) if cosine else v).alias("v"))


def _cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, cell, r): the nearest pivot and the distance to it."""
    held = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            cell, r = np.zeros(len(v), np.int32), np.zeros(len(v))
            for at in range(0, len(v), STEP):
                d = _distances(v[at : at + STEP], held.value, False)
                cell[at : at + STEP], r[at : at + STEP] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell), pa.array(r)], ["vec_id", "v", "cell", "r"])

    return df.mapInArrow(assign, "vec_id bigint, v array<double>, cell int, r double")


def shards_of(bank: DataFrame, pivots: np.ndarray, rows: int) -> tuple[DataFrame, pa.Table]:
    """The bank (vec_id, v) as (v, shard), and its shards (shard, cell, lo, hi, n) by number: rows of a cell in a ring of
    distances lo to hi from its pivot, in pieces of about `rows` rows; n is the ring's count at its first piece, else 0. There
    are at most (pivots x rings) + (bank rows / rows) shards."""
    placed = cut(_cells(bank, pivots))
    edges = placed.groupBy("cell").agg(F.percentile_approx("r", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])).alias("edges"))
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("r"))))
    sizes = ringed.groupBy("cell", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    pieces = sizes.withColumn("pieces", F.ceil(F.col("n") / rows).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    numbered = cut(pieces.withColumn("shard", F.row_number().over(Window.orderBy("cell", "ring", "piece")) - 1))
    piece = F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces")).cast("int")
    of_ring = numbered.groupBy("cell", "ring").agg(F.min("shard").alias("least"), F.first("pieces").alias("pieces"))
    own = ringed.join(F.broadcast(of_ring), ["cell", "ring"]).select("v", (F.col("least") + piece).alias("shard"))
    return own, numbered.select("shard", "cell", "lo", "hi", F.when(F.col("piece") == 0, F.col("n")).otherwise(0).alias("n")).toArrow().sort_by("shard")


def candidate_shards(queries: DataFrame, pivots: np.ndarray, shards: pa.Table, k: int) -> DataFrame:
    """(vec_id, v, cell, shards): for each query the shards that can hold one of its k nearest rows. A row at distance r from
    a pivot is, by the triangle inequality, at least |d - r| and at most d + r from a query at distance d from the pivot;
    the rings that surely hold k rows bound the k-th distance, and rings whose least distance is above it are left out."""
    held = queries.sparkSession.sparkContext.broadcast((pivots, *(shards.column(c).to_numpy() for c in ("cell", "lo", "hi", "n"))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, cell, lo, hi, n = held.value
        for batch in batches:
            v = _matrix(batch.column("v"))
            own, found, counts = np.zeros(len(v), np.int32), [], [0]
            for at in range(0, len(v), STEP):
                part = v[at : at + STEP]
                to = _distances(part, points, False)
                own[at : at + STEP] = to.argmin(1)
                d = to[:, cell]
                most = np.argsort(d + hi, axis=1)
                enough = np.minimum((np.cumsum(n[most], axis=1) < k).sum(1), len(cell) - 1)
                bound = np.take_along_axis(d + hi, np.take_along_axis(most, enough[:, None], 1), 1)
                slack = SLACK * (1 + np.sqrt((part * part).sum(1))[:, None] + np.sqrt((points * points).sum(1).max()))
                keep = ~(np.maximum(d - hi, lo - d) > bound + slack)  # NaN is kept
                found.append(np.nonzero(keep)[1].astype(np.int32))
                counts.extend(keep.sum(1))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own), lists], ["vec_id", "v", "cell", "shards"])

    return queries.mapInArrow(choose, "vec_id bigint, v array<double>, cell int, shards array<int>")


def nearest_in_bank(queries: DataFrame, bank: DataFrame, k: int, cosine: bool, rows: int = BLOCK, held: int = HELD) -> DataFrame:
    """(vec_id, distances): ascending distances of each query to its k nearest bank rows (all, if fewer; no row for an empty bank).
    queries, bank: vec_id, embedding. A bank of at most `held` bytes, measured first, is sent to every task and the queries
    aren't moved. A larger one is cut into shards around pivots (bank rows of the lowest hashes); a block of queries of one cell
    meets only the shards that `candidate_shards` names for it, by a matrix product, and the shards' best are merged."""
    q, b = _vectors(queries, cosine), _vectors(bank, cosine)
    count, width = b.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if 8 * count * width <= held:
        small = queries.sparkSession.sparkContext.broadcast(_matrix(b.select("v").toArrow().column("v")))

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _nearest(batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), small.value, k, cosine).to_batches()

        return q.mapInArrow(beside, NEAR).groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("distances"))
    b = cut(b)
    pivots = _matrix(b.where(~F.exists("v", F.isnan)).orderBy(F.xxhash64("v"), "vec_id").limit(PIVOTS).select("v").toArrow().column("v"))
    if not len(pivots):
        pivots = np.zeros((1, width))
    own, shards = shards_of(b, pivots, rows)
    chosen = candidate_shards(q, pivots, shards, k)
    crowd = chosen.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("salts"))
    chosen = cut(chosen.join(F.broadcast(crowd), "cell").withColumn("part", F.struct("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).alias("salt"))))
    meeting = chosen.select("vec_id", "v", "part", F.explode("shards").alias("shard"))
    met = meeting.select(F.col("part").alias("block"), F.col("shard").alias("of")).distinct()
    banked = own.join(met, F.col("shard") == F.col("of")).select("block", "of", "v")

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left.column("vec_id").to_numpy(), _matrix(left.column("v")), _matrix(right.column("v")), k, cosine)

    found = meeting.groupBy("part", "shard").cogroup(banked.groupBy("block", "of")).applyInArrow(pairs, NEAR)
    return found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("distances"))


def patch_knn(embeddings: DataFrame, bank: DataFrame) -> DataFrame:
    """(item, score): largest over an item's patches of 1 - the best cosine to the bank."""
    near = nearest_in_bank(embeddings.select("vec_id", "embedding"), bank, 1, True)
    return embeddings.select("vec_id", "item").join(near, "vec_id").groupBy("item").agg(F.max(F.col("distances")[0]).alias("score"))


def bundle_score(features: DataFrame, bank: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, score): mean Euclidean distance to the k nearest bank rows after scaling by the bank's mean and population
    deviation."""
    parts = bank.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-9).alias("s"))
    scale = parts.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("p")).scalar()
    scaled = lambda df: df.withColumn("__p", scale).select("vec_id", F.zip_with(F.col("embedding").cast("array<double>"), F.col("__p"), lambda x, p: (x - p["m"]) / p["s"]).alias("embedding"))
    near = nearest_in_bank(scaled(features), scaled(bank), k, False)
    return near.select("vec_id", (F.aggregate("distances", F.lit(0.0), lambda t, x: t + x) / F.size("distances")).alias("score"))


def triage_features(records: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """(sim, frame, sev, kind, one log1p column a detector); kind: the type, or none where the frame is clean."""
    wide = records.groupBy("sim", "frame", "sev", "type", "label").pivot("detector", list(detectors)).agg(F.first("score"))
    return wide.select("sim", "frame", "sev", F.when(F.col("label"), F.col("type")).otherwise("none").alias("kind"), *[log1p_abs(F.col(d)).alias(d) for d in detectors])


def assert_no_leakage(columns: Sequence[str]) -> None:
    """Features must not come from the simulated stress."""
    if bad := [c for c in columns if "stress" in c.lower()]:
        raise ValueError(f"leaking features: {bad}")


Triage = Boosted


def fit_triage(train: DataFrame, features: Sequence[str], rounds: int = 300, depth: int = 4, **parameters) -> Triage:
    """Boosted trees over the features that predict kind, all kinds at once; labels in alphabetical order."""
    assert_no_leakage(features)
    return fit(train, features, "kind", rounds, depth, **parameters)


def predict_triage(model: Triage, df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """df with probs (array by label, tempered), pred (the first of equals) and conf."""
    out = with_logits(model, df, "__logits").withColumn("probs", softmax(F.col("__logits"), temperature)).drop("__logits")
    names = F.array(*[F.lit(x) for x in model.labels])
    return out.withColumn("conf", F.array_max("probs")).withColumn("pred", F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int")))


def truth_index(model: Triage, kind: Column) -> Column:
    """Place of a kind among the model's labels, from 0; null if it isn't one."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in model.labels]), kind), F.lit(0)).cast("int") - 1


def evaluate_triage(predicted: DataFrame, model: Triage, coverage: float = 0.8, target: float = 0.95) -> DataFrame:
    """One row from (item, kind, pred, conf, probs): n, accuracy, macro_f1, ece, brier over all classes, acc_at_coverage,
    coverage and tau."""
    rows = predicted.select("item", F.col("kind").alias("truth"), "pred", "conf", "probs", (F.col("pred") == F.col("kind")).cast("int").alias("correct"), truth_index(model, F.col("kind")).alias("truth_index")).persist()  # each measure reads them
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
    for part in (macro_f1(rows, model.labels), ece(rows), brier_multiclass(rows)):
        out = out.withColumn(part.columns[0], part.scalar())
    best = selective(rows, coverage, target)
    return out.withColumn("s", best.select(F.struct(*best.columns).alias("s")).scalar()).select("*", "s.*").drop("s")


def fit_temperature(probs: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 40) -> float:
    """The temperature of least negative log-likelihood for (probs, truth_index), by a logarithmic grid refined once. The
    grid is exploded inside each row's aggregation input, never joined."""
    for _ in range(2):
        grid = [float(t) for t in np.geomspace(low, high, steps)]
        logs = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12))))

        def nll(t: Column) -> Column:
            scaled = F.transform(F.col("logs"), lambda v: v / t)
            top = F.array_max(scaled)
            return top + F.log(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.element_at(scaled, F.col("truth_index") + 1)

        sums = probs.withColumn("logs", logs).agg(*[F.avg(nll(F.lit(t))).alias(str(i)) for i, t in enumerate(grid)]).first()
        best = min(range(steps), key=lambda i: sums[i])
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, steps - 1)]
    return grid[best]


@dataclass
class Calibrated:
    """Boosted trees with the temperature and the confidence below which they abstain, both from rows they weren't fitted on."""

    model: Triage
    temperature: float
    tau: float

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_triage(self.model, df, self.temperature)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """evaluate_triage's row, with this model's temperature and tau."""
        found = evaluate_triage(self.predict(df), self.model)
        return found.withColumns({"temperature": F.lit(self.temperature), "tau": F.lit(self.tau)})


def fit_calibrated(train: DataFrame, calibration: DataFrame, features: Sequence[str], target: float = 0.95, **parameters) -> Calibrated:
    """Trees fitted on train; temperature and tau (the last confidence at which cumulative accuracy is target) on calibration
    (with a column item). Calibration rows of a kind that train doesn't have tell nothing about the temperature."""
    model = fit_triage(train, features, **parameters)
    raw = cut(predict_triage(model, calibration).select("item", "kind", "probs", truth_index(model, F.col("kind")).alias("truth_index")))
    temperature = fit_temperature(raw.where("truth_index is not null").select("probs", "truth_index"))
    logs = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    tempered = raw.withColumn("probs", softmax(logs, temperature)).withColumn("conf", F.array_max("probs"))
    right = F.coalesce(F.array_position("probs", F.col("conf")) - 1 == F.col("truth_index"), F.lit(False))
    return Calibrated(model, temperature, fit_tau(tempered.select("item", "conf", right.cast("int").alias("correct")), target))


def heldout_severity(train: DataFrame, calibration: DataFrame, test: DataFrame, features: Sequence[str], severity: int = 1, **parameters) -> DataFrame:
    """One row: how a model that never saw failures of one severity does on those and on clean frames."""
    seen = (F.col("kind") == "none") | (F.col("sev") != severity)
    model = fit_calibrated(train.where(seen), calibration.where(seen), features, **parameters)
    return model.evaluate(test.where((F.col("kind") == "none") | (F.col("sev") == severity)))


def heldout_type(train: DataFrame, calibration: DataFrame, test: DataFrame, features: Sequence[str], kind: str, **parameters) -> DataFrame:
    """One row: the share of frames of a kind that the model never saw on which it abstains, and its measures on the rest."""
    seen = F.col("kind") != kind
    model = fit_calibrated(train.where(seen), calibration.where(seen), features, **parameters)
    away = abstain_rate(model.predict(test.where(~seen)), model.tau).scalar()
    return model.evaluate(test.where(seen)).select(F.lit(kind).alias("heldout"), away.alias("abstain_rate"), "*")


def diagnostic_tree_cv(df: DataFrame, features: Sequence[str], label: str = "kind", folds: int = 5, depth: int = 4, key: str = "item", carry: Sequence[str] = ()) -> DataFrame:
    """(key, label, carried columns, pred): predictions of a shallow tree for each row by a model of the other folds; folds are dealt by
    hash within each label."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw("fold", F.col(key)), key))
    folded = df.withColumn("fold", rank % folds)
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(df)
    ready = VectorAssembler(inputCols=list(features), outputCol="x").transform(index.transform(folded))
    ready = cut(ready.select(key, label, *carry, "fold", "x", "y"))  # each fold reads all rows twice
    names = F.array(*[F.lit(x) for x in index.labels])
    out = None
    for k in range(folds):
        model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=depth, seed=0).fit(ready.where(F.col("fold") != k))
        part = model.transform(ready.where(F.col("fold") == k)).select(key, label, *carry, F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out

