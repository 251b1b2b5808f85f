"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words that the labelled sample ties to a class. For every labelled document that
mentions an identity group, a counterfactual is made by swapping its identity terms for others of their kind or for a
general word, and the square of the score's change is a penalty of the fit; so the mention of a group alone does not move the score, whatever
groups the toxic examples happen to name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, carried, chunks, discard, pieces, saved, small_batches, word_hashes

carried(__name__)

#: Labelled documents that are fitted at most: those of the lowest key hashes.
SAMPLE = 20_000
CELL_BITS = 22  # words are told apart by so many bits of their hashes, which bounds the model's vocabulary; none is left out
LEAST_DOCS = 5  # documents of the sample that must have a word of the model
LEAST_Z = 3.0
PENALTY = 10.0  # of squared changes of the logit under swaps
STEPS = 600

# fixed values: identity terms by kind; a term is swapped for others of its kind
IDENTITIES = {
    "gender": ("women", "men", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    "faith": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu"),
    "origin": ("immigrants", "refugees", "africans", "asians", "europeans", "mexicans", "arabs", "americans", "black", "white", "asian", "latino"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    "ability": ("disabled", "blind", "deaf", "autistic"),
    "age": ("elderly", "teenagers", "seniors", "millennials"),
}

OTHER = np.ones(256, bool)  # a word is a run of letters: a-z and bytes beyond ASCII
OTHER[97:123] = False
OTHER[128:] = False


HEAD = 7  # bytes of the word beginnings that are features too


def word_sets(texts: pa.Array, heads: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct cells of each text's words, and of their beginnings."""
    for _, data, bounds in chunks(texts):
        low = LOWER_TABLE[data]
        h, at = word_hashes(low, bounds, OTHER)
        b = ~word_hashes(low, bounds, OTHER, HEAD)[0] if heads else h[:0]
        for i in range(len(bounds) - 1):
            yield np.unique(np.concatenate([h[at[i] : at[i + 1]], b[at[i] : at[i + 1]]]) >> np.uint64(64 - CELL_BITS))


def hash_of(words) -> np.ndarray:
    """Cells of single words, in order."""
    return np.concatenate([next(word_sets(pa.array([w]), heads=False)) for w in words])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets, y = list(word_sets(batch.column("text"))), batch.column("y").to_numpy(zero_copy_only=False)
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(y, [len(s) for s in sets]))], ["word", "y"])


def _presence(words: np.ndarray) -> Callable:
    """(h, y, text) -> (h, y, positions among the sorted words, as 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [np.searchsorted(words, s[np.isin(s, words, assume_unique=True)]).astype(np.int32).tobytes() for s in word_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(found, pa.binary())], ["h", "y", "at"])

    return run


def swapped(x: np.ndarray, groups: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x (presence) that mention an identity, and their counterfactuals, two of each: each mentioned column moves
    to another column of its group, or to a word for people in general, which the model doesn't have."""
    rows = np.flatnonzero(sum(x[:, g].any(1).astype(int) for g in groups)) if groups else np.zeros(0, int)
    own, other, general = x[rows], x[rows].copy(), x[rows].copy()
    for g in groups:
        general[:, g] = False
        for i in np.flatnonzero(own[:, g].any(1)):
            there = own[i, g]
            other[i, g] = False
            other[i, rng.permutation(g[~there])[: there.sum()] if (~there).any() else g] = True
    return np.concatenate([own, own]), np.concatenate([other, general])


def fit(at: np.ndarray, row: np.ndarray, width: int, y: np.ndarray, groups: list[np.ndarray], penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of width words and bias by accelerated gradient descent on cross-entropy, a small ridge and the swap penalty.

    Text row[i] has word at[i]; only these pairs are held. Swaps change no columns but those of groups, so their
    differences are kept for these columns alone.
    """
    terms = np.unique(np.concatenate([*groups, np.zeros(0, int)])).astype(int)
    x = np.zeros((len(y), len(terms)), bool)
    named = np.isin(at, terms)
    x[row[named], np.searchsorted(terms, at[named])] = True
    a, b = swapped(x, [np.searchsorted(terms, g) for g in groups], np.random.default_rng(5))
    d = a.astype(np.float32) - b.astype(np.float32)
    w, bias = np.zeros(width), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) + bias, -30, 30)))
        e = (p - y) / len(y)
        g = np.bincount(at, e[row], width) + 2e-4 * w
        if len(d):
            g[terms] += 2 * penalty / len(y) * (d.T @ (d @ w[terms].astype(np.float32)))
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - 0.05 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= 0.05 * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, bias


def scored(docs: DataFrame, labels: DataFrame, held_out: Callable, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, cut: float = 0.3, penalty: float = PENALTY) -> DataFrame:
    """One row per row of docs: key, held_out, score (probability of label 1), predicted (1 if score >= cut).

    held_out: column -> boolean column of the rows whose labels aren't learnt from. Null and empty texts have no words and
    the score of none. Null labels and keys aren't learnt from; of repeated labels of a key the largest counts. With no
    labelled rows the score is 0, with one class only that class's share. Repeated rows get equal scores. An empty table
    gives no rows. Very long texts are read whole, a batch of rows at a time. Columns other than key and text aren't read.

    Every word of LEAST_DOCS documents and LEAST_Z is in the model. The driver holds one 32-bit number for each such word
    of each of at most sample texts, and the weights, at most 2**CELL_BITS.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("y"))
    chosen = saved(known.withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(sample), "toxicity-sample")
    learnt = saved(rows.join(chosen, "key").select("h", "y", "text"), "toxicity-texts")
    n, positives = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = positives / n if n else 0.0
    counts = learnt.select("y", "text").mapInArrow(_word_rows, "word bigint, y double").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    z = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    terms = {k: hash_of(v) for k, v in IDENTITIES.items()}
    beginnings = np.concatenate([next(word_sets(pa.array([w]))) for v in IDENTITIES.values() for w in v])  # no way round the swaps
    with small_batches(docs.sparkSession):
        tied = counts.where((F.col("n") >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z)).select("word").collect()  # 2**CELL_BITS rows at most
        chosen_words = np.array([r["word"] for r in tied], np.int64).view(np.uint64)
        words = np.unique(np.concatenate([chosen_words[~np.isin(chosen_words, beginnings)], *terms.values()]))
        weights, bias = np.zeros(len(words)), float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        if 0 < share < 1:
            found = learnt.mapInArrow(_presence(words), "h bigint, y double, at binary").groupBy("h").agg(F.first("y").alias("y"), F.min("at").alias("at")).orderBy("h").collect()  # sample rows at most
            lists = [np.frombuffer(r["at"], np.int32) for r in found]
            rows_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            weights, bias = fit(np.concatenate(lists), rows_of, len(words), np.array([r["y"] for r in found]), [np.searchsorted(words, t) for t in terms.values()], penalty)
    discard(chosen, learnt)
    empty = not n

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            logits = np.array([weights[np.searchsorted(words, s[np.isin(s, words, assume_unique=True)])].sum() for s in word_sets(batch.column("text"))]) + bias
            p = np.zeros(batch.num_rows) if empty else 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(p, pa.float64())], ["key", "score"])

    out = rows.mapInArrow(score, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
