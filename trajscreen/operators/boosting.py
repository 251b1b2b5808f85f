"""Multiclass gradient boosting with a softmax loss over histograms.

Features are cut into bins at quantiles of all rows. All that the loss and the trees can tell of the rows is then how many of each
kind fall in each combination of bins, and Spark counts these over all rows. The rounds run on the counted combinations, which
few features bound whatever the number of rows; with more than CELLS of them those of the lowest hashes are fitted (each with all
its rows). Rows are predicted in tasks, each distinct combination of a batch once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajscreen.functions.lineage import cut
from trajscreen.functions.workers import carried

carried(__name__)

BINS = 64  # the first holds nulls
CELLS = 200_000


@dataclass
class Boosted:
    """Labels and features by name; cuts of each feature; the first scores; and for each round and label a tree: of each inner node (in
    heap order) the feature and the last bin that goes left, of each leaf its value."""

    labels: list[str]
    features: list[str]
    cuts: list[np.ndarray]
    first: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray


def codes(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of values (rows by features): 0 for null or no number, then by the cuts at or below the value."""
    return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, "right")) for v, c in zip(columns, cuts, strict=True)], axis=1).astype(np.int64)


def _grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, least: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bound, leaf values, leaf of each row) of one tree, level by level, by gradients and curvatures of the rows. A node
    stays whole where no cut leaves `least` rows on both sides and gains."""
    inner = 2**depth - 1
    feature, bound = np.zeros(inner, np.int16), np.full(inner, BINS, np.int16)
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        count, start = 2**level, 2**level - 1
        best_gain, best = np.full(count, 1e-9), np.zeros((count, 2), np.int64)
        for f in range(bins.shape[1]):
            at = node * BINS + bins[:, f]
            gs, hs, ns = (np.bincount(at, weights=x, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1) for x in (g, h, n))
            ga, ha, na = (x[:, -1:] for x in (gs, hs, ns))
            gain = gs**2 / (hs + 1e-9) + (ga - gs) ** 2 / (ha - hs + 1e-9) - ga**2 / (ha + 1e-9)
            gain = np.where((ns >= least) & (na - ns >= least), gain, -1.0)
            top = gain.argmax(axis=1)
            won = gain[np.arange(count), top] > best_gain
            best_gain[won] = gain[np.arange(count), top][won]
            best[won] = np.stack([np.full(count, f), top], axis=1)[won]
        cut = best_gain > 1e-9
        feature[start : start + count][cut], bound[start : start + count][cut] = best[cut, 0], best[cut, 1]
        node = 2 * node + (bins[np.arange(len(bins)), feature[start + node]] > bound[start + node])
    gs, hs = (np.bincount(node, weights=x, minlength=2**depth) for x in (g, h))
    return feature, bound, -rate * gs / (hs + 1e-9), node


def boosted(bins: np.ndarray, counts: np.ndarray, rounds: int, depth: int, rate: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, feature, bound, value) from combinations of bins and how many rows of each label (columns) each has."""
    n = counts.sum(axis=1)
    k = counts.shape[1]
    first = np.log((counts.sum(axis=0) + 1e-9) / max(n.sum(), 1e-9))
    score = np.tile(first, (len(bins), 1))
    feature, bound = np.zeros((rounds, k, 2**depth - 1), np.int16), np.zeros((rounds, k, 2**depth - 1), np.int16)
    value = np.zeros((rounds, k, 2**depth))
    for r in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i in range(k):
            own = p[:, i]
            feature[r, i], bound[r, i], value[r, i], leaf = _grown(bins, n * own - counts[:, i], n * np.maximum(own * (1 - own), 1e-6), n, depth, least, rate)
            score[:, i] += value[r, i][leaf]
    return first, feature, bound, value


def logits(bins: np.ndarray, first: np.ndarray, feature: np.ndarray, bound: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Scores (rows by labels): the first ones and those of all trees."""
    out = np.tile(first, (len(bins), 1))
    depth, rows = int(np.log2(value.shape[2])), np.arange(len(bins))
    for r in range(value.shape[0]):
        for i in range(value.shape[1]):
            at = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (bins[rows, feature[r, i, at]] > bound[r, i, at])
            out[:, i] += value[r, i, at - (2**depth - 1)]
    return out


def _cutter(cuts: Sequence[np.ndarray]):
    def run(*columns: pa.Array) -> pa.Array:
        found = codes([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], cuts)
        return pa.array(list(found.astype(np.int16)), pa.list_(pa.int16()))

    return F.arrow_udf(run, "array<smallint>")


def fit(train: DataFrame, features: Sequence[str], label: str, rounds: int = 300, depth: int = 4, rate: float = 0.05, least: float = 20.0) -> Boosted:
    """Trees over the features that predict label (text); labels in alphabetical order. least: rows on each side of a cut."""
    points = [i / (BINS - 1) for i in range(1, BINS - 1)]
    found = train.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), points, 10_000).alias(str(i)) for i, c in enumerate(features)]).first()
    cuts = [np.unique(np.array(found[i] or [], np.float64)) for i in range(len(features))]
    binned = train.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), _cutter(cuts)(*[F.col(f"`{c}`").cast("double") for c in features]).alias("bins"))
    labels = sorted(r[0] for r in binned.select("label").distinct().collect())  # kinds of failure
    cells = cut(binned.groupBy("bins").agg(*[F.count_if(F.col("label") == x).alias(str(i)) for i, x in enumerate(labels)]))
    share = min(1.0, CELLS / max(cells.count(), 1))
    table = cells.where(F.shiftrightunsigned(F.xxhash64("bins"), 33) < F.lit(share * 2**31)).orderBy("bins").toArrow()  # about CELLS rows at most
    bins = np.array(table.column("bins").to_pylist(), np.int64).reshape(-1, len(features))
    counts = np.stack([table.column(str(i)).to_numpy() for i in range(len(labels))], axis=1).astype(np.float64) if labels else np.zeros((0, 0))
    return Boosted(labels, list(features), cuts, *boosted(bins, counts, rounds, depth, rate, least))


def with_logits(model: Boosted, df: DataFrame, name: str) -> DataFrame:
    """df with an array of scores, one a label."""
    cuts, arrays = model.cuts, (model.first, model.feature, model.bound, model.value)

    def run(*columns: pa.Array) -> pa.Array:
        found = codes([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], cuts)
        distinct, same = np.unique(found, axis=0, return_inverse=True)
        return pa.array(list(logits(distinct, *arrays)[same.reshape(-1)]), pa.list_(pa.float64()))

    return df.withColumn(name, F.arrow_udf(run, "array<double>")(*[F.col(f"`{c}`").cast("double") for c in model.features]))
