"""Hard-negative mining: for an anchor and each of its nearest rows of the same label, the best rows of other labels within a
window of scores, by exact inner products of integer vectors.

Rows are dealt to tiles by sort-tile-recursive cuts that a bounded sample fixes; within a tile they are packed by the same rule
into pages, and over the pages stands an R-tree of minimum bounding boxes. A box gives every coordinate an interval and so the
inner product with an anchor one. Each (tile, block of anchors) is one task: from the best box on, boxes are opened until the
best one left can't hold a row that a window still wants. What each tile finds (k rows a window at most) is merged by anchor.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. A shorter vector is one whose last
components are 0. Several rows of one id count as one, the least by label and vector. Equal scores go by id, so repeated vectors
have a defined order. Anchors without another row of their label, and positives with nothing in their window, give no rows.
Columns other than the three named take no part, whatever they are called. An empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, discard, saved

carried(__name__)

SAMPLE = 16_384  # rows that fix the cuts between tiles; every row is dealt by them
SLABS = 1024  # cuts of the sample at most; slabs with more rows than a tile takes are dealt on by a hash of the id
PAGE = 64  # rows of a page
FANOUT = 16  # boxes under a box
ANCHORS = 8192  # of a block
LARGEST = 2**28  # of a component, so that inner products of 64 of them are whole numbers of 64 bits


# --- packing ---------------------------------------------------------------------------------------------------------


def cuts(x: np.ndarray, parts: int, least: int = 1) -> tuple[np.ndarray, list[int], dict]:
    """Sort-tile-recursive order of the rows of x, where its parts begin (each of about len(x) / parts rows, a multiple of
    least), and the cuts themselves: a tree {'c': coordinate, 'at': bounds, 'next': trees or numbers of parts}. About four
    slabs a coordinate, the coordinates by falling variance."""
    rounds = max(1, round(np.log2(max(parts, 2)) / 2))
    axes = np.argsort(-x.var(axis=0), kind="stable")[: min(rounds, x.shape[1])] if len(x) else []
    starts: list[int] = []
    order = np.arange(len(x))

    def split(a: int, b: int, left: int, depth: int):
        pages = -(-(b - a) // least)
        left = min(left, pages)
        if left <= 1 or depth >= len(axes):
            starts.append(a)
            return len(starts) - 1
        slabs = min(left, int(np.ceil(left ** (1 / (len(axes) - depth)) - 1e-9)))
        values = x[order[a:b], axes[depth]]
        order[a:b] = order[a:b][np.argsort(values, kind="stable")]
        edges = sorted({a + least * (pages * i // slabs) for i in range(slabs)} | {b})
        at = [float(x[order[e], axes[depth]]) for e in edges[1:-1]]
        return {"c": int(axes[depth]), "at": at, "next": [split(s, e, -(-left // slabs), depth + 1) for s, e in zip(edges, edges[1:], strict=False)]}

    tree = split(0, len(x), parts, 0)
    return order, starts, tree


def placed(x: np.ndarray, tree: dict | int) -> np.ndarray:
    """The number of the part that each row of x falls in."""
    out = np.zeros(len(x), np.int64)

    def go(rows: np.ndarray, node) -> None:
        if not isinstance(node, dict):
            out[rows] = node
            return
        slab = np.searchsorted(node["at"], x[rows, node["c"]], "right")
        for i, below in enumerate(node["next"]):
            if len(own := rows[slab == i]):
                go(own, below)

    go(np.arange(len(x)), tree)
    return out


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of so many columns, the missing last ones 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    own = np.repeat(np.arange(len(sizes)), sizes)
    out[own, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


# --- search ----------------------------------------------------------------------------------------------------------


class Tree:
    """Pages (ids, labels, values, in packed order) with the levels of boxes over them."""

    def __init__(self, ids: np.ndarray, labels: list, values: np.ndarray, starts: np.ndarray) -> None:
        self.codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.ids, self.labels = ids, np.array([self.codes[x] for x in labels])
        most = float(np.abs(values).max(initial=0))
        self.kind = np.float64 if values.shape[1] * most * LARGEST < 2**53 or values.shape[1] * most * most < 2**52 else np.int64
        self.values, self.most = values.astype(self.kind), most
        self.starts = [starts]
        self.low, self.high = [np.minimum.reduceat(self.values, starts)], [np.maximum.reduceat(self.values, starts)]
        while len(self.low[-1]) > FANOUT:
            at = np.arange(0, len(self.low[-1]), FANOUT)
            self.starts.append(at)
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))

    def search(self, q: np.ndarray, own_id: int, own_label, same: bool, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, most) the k best (score, id) of rows of q's label (or of any other), q's own row left out."""
        exact = self.kind if self.kind is np.int64 or len(q) * self.most * float(np.abs(q).max(initial=0)) < 2**53 else np.int64
        q = q.astype(exact)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = np.array([w[0] for w in windows], np.float64)
        tops = np.array([w[1] for w in windows], np.float64)
        code = self.codes.get(own_label, -1)
        heap: list[tuple] = []

        def offer(level: int, a: int, b: int) -> None:
            low, high = self.low[level][a:b].astype(exact, copy=False), self.high[level][a:b].astype(exact, copy=False)
            upper, lower = high @ up + low @ down, low @ up + high @ down
            wanted = ((upper[:, None] >= floors) & (lower[:, None] <= tops)).any(axis=1)
            for i in np.flatnonzero(wanted).tolist():
                heapq.heappush(heap, (-upper[i], level, a + i))

        offer(len(self.low) - 1, 0, len(self.low[-1]))
        while heap:
            upper, level, i = heapq.heappop(heap)
            if -upper < floors.min():
                break
            starts = self.starts[level]
            a, b = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(self.low[level - 1] if level else self.values)
            if level:
                offer(level - 1, a, b)
                continue
            scores = self.values[a:b].astype(exact, copy=False) @ q
            fit = ((self.labels[a:b] == code) == same) & (self.ids[a:b] != own_id)
            for w, found in enumerate(best):
                for j in np.flatnonzero(fit & (scores >= floors[w]) & (scores <= tops[w])).tolist():
                    one = (int(scores[j]), -int(self.ids[a + j]))
                    if len(found) < k:
                        heapq.heappush(found, one)
                    elif one > found[0]:
                        heapq.heapreplace(found, one)
                    if len(found) == k:
                        floors[w] = found[0][0]
        return [[(s, -i) for s, i in sorted(found, reverse=True)] for found in best]


def _paged(width: int):
    """One tile's rows -> its pages in packed order, each the ids, labels and values of its rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"), width)
        order, _, _ = cuts(x, -(-len(x) // PAGE), PAGE)
        ids, labels = table.column("id").to_numpy()[order], table.column("label").take(pa.array(order)).to_pylist()
        bounds = [*range(0, len(x), PAGE), len(x)]
        rows = [(ids[a:b].tobytes(), labels[a:b], x[order[a:b]].astype(np.int32).tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
        n = len(rows)
        return pa.table({"tile": pa.array([key[0].as_py()] * n, pa.int32()), "page": pa.array(range(n), pa.int32()), "ids": pa.array([r[0] for r in rows], pa.binary()), "labels": pa.array([r[1] for r in rows], pa.list_(pa.string())), "cells": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _searched(width: int, same: bool, k: int):
    """The pages of a tile and a block of anchors -> (id, place of the window, found id, score)."""

    def run(key: tuple, pages: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if pages.num_rows and anchors.num_rows:
            pages = pages.sort_by("page")
            parts = [np.frombuffer(x, np.int64) for x in pages.column("ids").to_pylist()]
            values = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, width) for x in pages.column("cells").to_pylist()])
            starts = np.cumsum([0, *map(len, parts[:-1])])
            tree = Tree(np.concatenate(parts), [x for p in pages.column("labels").to_pylist() for x in p], values, starts)
            q = matrix(anchors.column("vec"), width)
            for i, (one, label, windows) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "windows")), strict=True)):
                found = tree.search(q[i], one, label, same, [(w["least"], w["most"]) for w in windows], k)
                out += [(one, windows[w]["place"], other, score) for w, rows in enumerate(found) for score, other in rows]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "place", "found", "score"])

    return run


def _best(pages: DataFrame, tiles: int, anchors: DataFrame, blocks: int, width: int, same: bool, k: int) -> DataFrame:
    """(id, place, found, score, rank) of the k best rows for each window of anchors (id, label, vec, windows)."""
    of_block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.select("*", of_block, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(_searched(width, same, k), "id bigint, place int, found bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on the columns of
    rows) and each of its `positives` best other rows of its label the `negatives` best rows of other labels whose score s has
    least * p <= 100 * s <= most * p for the positive's score p. Components are floor(scale * x), scores their inner products;
    higher first, then smaller ids."""
    spark = rows.sparkSession
    cells = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).where(sound)
    named = kept.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), cells.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    held = saved(named, "vectors")
    n, ids, width, anchors, large = held.agg(F.count(F.lit(1)), F.count_distinct("id"), F.max(F.size("vec")), F.count_if("anchor"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()
    if (large or 0) > LARGEST or (large or 0) ** 2 * (width or 0) >= 2**62:
        raise ValueError(f"a component of {large} is too large for exact scores")
    if ids < n:
        once = saved(held.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("m")).select("id", "m.*"), "vectors")
        discard(held)
        held = once
        n, anchors = held.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    width = max(width or 0, 1)
    per_tile = min(32_768, max(1024, n // 64))
    sample = held.select("vec", F.xxhash64("id", F.lit("tiles")).alias("h")).orderBy("h").limit(SAMPLE).select("vec").toArrow()
    slabs = min(SLABS, -(-n // per_tile))
    tree = cuts(matrix(sample.column("vec"), width), max(slabs, 1))[2]

    @F.arrow_udf("int")
    def slab(vec: pa.Array) -> pa.Array:
        return pa.array(placed(matrix(vec, width), tree), pa.int32())

    dealt = held.withColumn("slab", slab("vec"))
    pieces, first, total = {}, {}, 0
    for r in dealt.groupBy("slab").count().orderBy("slab").collect():  # SLABS rows at most
        pieces[r["slab"]], first[r["slab"]] = -(-r["count"] // per_tile), total
        total += pieces[r["slab"]]
    if not total:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    tile = F.element_at(as_map(first), F.col("slab")) + F.pmod(F.xxhash64("id", F.lit("piece")), F.element_at(as_map(pieces), F.col("slab"))).cast("int")
    tiled = dealt.select("id", "label", "vec", tile.alias("tile"))
    pages = saved(tiled.groupBy("tile").applyInArrow(_paged(width), "tile int, page int, ids binary, labels array<string>, cells binary"), "pages")
    blocks = max(1, -(-anchors // ANCHORS))
    every = F.array(F.struct(F.lit(0).alias("place"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")))
    asked = held.where("anchor").select("id", "label", "vec")
    near = saved(_best(pages, total, asked.withColumn("windows", every), blocks, width, True, positives), "positives")
    p = F.col("score")
    window = F.struct(F.col("rank").alias("place"), F.ceil(p * least / F.lit(100.0)).cast("double").alias("least"), F.floor(p * most / F.lit(100.0)).cast("double").alias("most"))
    windows = near.where(p * least <= p * most).groupBy("id").agg(F.collect_list(window).alias("windows"))
    far = _best(pages, total, asked.join(windows, "id"), blocks, width, False, negatives)
    pairs = near.select(F.col("id").alias("anchor_id"), F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives_of = far.select(F.col("id").alias("anchor_id"), "place", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = saved(negatives_of.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(held, pages, near)
    return out


ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) q WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
