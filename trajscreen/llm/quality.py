"""Quality classifier: random-indexing token vectors pooled per document, a two-layer numpy network, a temperature.

Texts are cut into tokens: runs of letters, of digits, and of other signs, plus each word's shape and its repetition. Every
token hashes to a sparse random index vector; a token's context vector sums the index vectors of its neighbours over all
documents and is held in a table of fixed size, indexed by token hash. A document is the mean of its tokens' context
vectors. The network is fitted on the driver from a bounded sample of labelled documents' vectors; its temperature
on the sample's last part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, carried, chunks, discard, mix, pieces, saved, small_batches, summed_table, word_hashes

carried(__name__)

DIMENSIONS = 48  # of a token vector
SIGNS = 4  # entries of an index vector that are not 0
TABLE_BITS = 14  # rows of the context table
SLICES = 8
#: Labelled documents that are fitted at most: those of the lowest key hashes.
SAMPLE = 8000
HIDDEN = 24
STEPS = 1500
SEED = 11

#: Class of each byte: 0 separator, 1 lower-case letter or part of a character beyond ASCII, 2 upper-case, 3 digit, 4 sign.
CLASSES = np.full(256, 4, np.uint8)
CLASSES[128:] = 1
CLASSES[97:123] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KINDS = 64  # shapes


def tokens_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token hashes, row bounds, repeats) of runs of rows. A word gives its lower-cased hash and its shape's hash, in turn;
    the shape has whether it holds signs, capitals (first, all), digits and letters, and whether the word two or less
    before it is the same."""
    for _, data, bounds in chunks(texts):
        kinds = CLASSES[data]
        words, at = word_hashes(LOWER_TABLE[data], bounds, kinds_separators())
        if not len(words):
            yield words, at, words
            continue
        inside = kinds != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < len(data)]
        begins[heads] = inside[heads]
        first = np.flatnonzero(begins)
        has = [np.add.reduceat((kinds == k).astype(np.int32), first) for k in (1, 2, 3, 4)]
        size = has[0] + has[1] + has[2] + has[3]
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[2:] |= words[2:] == words[:-2]
        shape = (has[3] > 0) + 2 * (has[1] >= 2) + 4 * (kinds[first] == 2) + 8 * (has[2] > 0) + 16 * ((has[3] >= 3) | (has[3] == size)) + 32 * same
        both = np.empty(2 * len(words), np.uint64)
        both[0::2] = words
        both[1::2] = mix(shape.astype(np.uint64) + np.uint64(1 << 40))
        yield both, 2 * at, shape


def kinds_separators() -> np.ndarray:
    return CLASSES == 0


def index_vectors() -> np.ndarray:
    """Sparse random vectors: for each table row, SIGNS positions and signs from a hash (rows x DIMENSIONS, int8)."""
    rows = np.arange(1 << TABLE_BITS, dtype=np.uint64)
    out = np.zeros((1 << TABLE_BITS, DIMENSIONS), np.int8)
    for k in range(SIGNS):
        h = mix(rows * np.uint64(SIGNS) + np.uint64(k))
        out[rows.astype(np.int64), (h % np.uint64(DIMENSIONS)).astype(np.int64)] = np.where(h >> np.uint64(63), 1, -1)
    return out


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """Context vectors (rows x DIMENSIONS) summed over all documents; each scaled to unit length. Tasks sum into a table of
    fixed size; the tables are added up in a tree, so no task reads more than a bounded number of them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        places = [np.flatnonzero(index[i]) for i in range(len(index))]
        width = max(map(len, places))
        at = np.zeros((len(index), width), np.int64)
        sign = np.zeros((len(index), width), np.float64)
        for i, p in enumerate(places):
            at[i, : len(p)], sign[i, : len(p)] = p, index[i, p]
        table = np.zeros(len(index) * DIMENSIONS)
        for batch in pieces(batches):
            for hashes, bounds, _ in tokens_of(batch.column(0)):
                c = cells(hashes)
                inner = np.ones(len(c), bool)
                for step in (1, 2):
                    if len(c) <= step:
                        continue
                    inner = np.ones(len(c) - step, bool)
                    for back in range(step):  # neighbours don't cross documents
                        edge = bounds[1:-1] - 1 - back
                        inner[edge[(edge >= 0) & (edge < len(inner))]] = False
                    a, b = c[:-step][inner], c[step:][inner]
                    pairs, counts = np.unique(np.concatenate([a << TABLE_BITS | b, b << TABLE_BITS | a]), return_counts=True)
                    a, b = pairs >> TABLE_BITS, pairs & ((1 << TABLE_BITS) - 1)
                    for j in range(width):
                        table += np.bincount(a * DIMENSIONS + at[b, j], weights=sign[b, j] * counts, minlength=len(table))
        for i, part in enumerate(np.split(table.astype(np.float32), SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "part"])

    parts = summed_table(docs.mapInArrow(gather, "slice int, part binary"), SLICES, np.float32).collect()
    table = np.zeros((SLICES, (DIMENSIONS << TABLE_BITS) // SLICES))
    for r in parts:  # SLICES rows of a fixed size
        table[r["slice"]] = np.frombuffer(zlib.decompress(r["part"]))
    table = table.reshape(1 << TABLE_BITS, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = DIMENSIONS + 2


def pooled(texts: pa.Array, context: np.ndarray) -> np.ndarray:
    """A row for each text: mean context vector of its tokens, log length, whether it has no words."""
    out = []
    for hashes, bounds, _ in tokens_of(texts):
        n = np.diff(bounds)
        m = np.zeros((len(n), WIDTH), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            c = cells(hashes)
            starts = bounds[:-1][full]
            m[full, :DIMENSIONS] = np.add.reduceat(context[c], starts, axis=0) / n[full, None]
        m[:, -2] = np.log1p(n) / 10
        m[:, -1] = n == 0
        out.append(m)
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)


def vectors(rows: DataFrame, context, others: str, names: list[str]) -> DataFrame:
    """rows (others.., text binary) -> others.., v binary (float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v = pooled(batch.column("text"), context.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x.tobytes() for x in v], pa.binary())], [*names, "v"])

    return rows.mapInArrow(run, f"{others}, v binary")


def fit_network(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Two layers (tanh, sigmoid) by Adam on cross-entropy, then a temperature on the last fifth of the rows."""
    rng = np.random.default_rng(SEED)
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / std
    cut = max(1, len(z) * 4 // 5)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in w]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, cut, min(256, cut))
        h = np.tanh(z[rows] @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
        e = (p - y[rows]) / len(rows)
        back = e[:, None] * w[2] * (1 - h * h)
        for i, g in enumerate((z[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum())):
            m, v = moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[i] = w[i] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "std": std, "w0": w[0], "b0": w[1], "w1": w[2], "b1": w[3], "t": np.array(1.0)}
    held = slice(cut, None) if len(z) - cut >= 50 else slice(None)
    logits = logit(model, x[held])
    best = min(np.geomspace(0.25, 8, 60), key=lambda t: float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / t))))
    return model | {"t": np.array(best)}


def logit(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - model["mean"]) / model["std"] @ model["w0"] + model["b0"]) @ model["w1"] + model["b1"]) / model["t"]


def fitted(docs: DataFrame, labels: DataFrame, held_out: Callable, key: str, text: str, label: str, sample: int) -> Callable[[pa.Array], np.ndarray]:
    """Learns from docs and labels; the returned function gives the scores of texts and runs on executors."""
    with small_batches(docs.sparkSession):
        return _fitted(docs, labels, held_out, key, text, label, sample)


def _fitted(docs: DataFrame, labels: DataFrame, held_out: Callable, key: str, text: str, label: str, sample: int) -> Callable[[pa.Array], np.ndarray]:
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    context = spark.sparkContext.broadcast(context_table(rows.select("text")))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("y"))
    chosen = saved(known.withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(sample), "quality-sample")
    labelled = rows.join(chosen.select("key", "y", "h"), "key").select("h", "key", "y", "text")
    # at most `sample` rows of a fixed size, but for repeated keys, of which one each is taken
    found = vectors(labelled, context, f"h bigint, key {kind}, y double", ["h", "key", "y"]).groupBy("h", "key", "y").agg(F.min("v").alias("v")).orderBy("h", "key").limit(sample).collect()
    discard(chosen)
    y = np.array([r["y"] for r in found])
    model = None
    if len(y) and 0 < y.mean() < 1:
        model = fit_network(np.stack([np.frombuffer(r["v"], np.float32) for r in found]).astype(np.float64), y)
    share = float(y.mean()) if len(y) else 0.5

    def score(texts: pa.Array) -> np.ndarray:
        x = pooled(texts, context.value).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit(model, x), -40, 40))) if model else np.full(len(x), share)

    return score


def scored(docs: DataFrame, labels: DataFrame, held_out: Callable, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """One row per row of docs: key, held_out, score (probability of label 1), predicted (1 if score >= cut).

    held_out: column -> boolean column of the rows whose labels aren't learnt from. Null and empty texts have a vector of
    their own kind and a score. Null labels and keys aren't learnt from; of repeated labels of a key the largest counts.
    With no labelled rows the score is 0.5, with one class only that class's share. Repeated rows get equal scores. An
    empty table gives no rows. Columns other than key and text aren't read.
    """
    score = fitted(docs, labels, held_out, key, text, label, sample)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score(batch.column("text")), pa.float64())], ["key", "score"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, held_out: Callable, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is cut or more; like scored() otherwise."""
    score = fitted(docs, labels, held_out, key, text, label, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(score(batch.column(text)) >= cut))

    return docs.mapInArrow(run, docs.schema)


def crc_remainder(key, divisor: int):
    """crc32 of the key as text, modulo divisor."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(divisor))
