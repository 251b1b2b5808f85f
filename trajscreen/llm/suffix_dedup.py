"""Removal of repeated byte strings by sorting suffixes deep-shallow.

Every 200-byte string holds an anchor: the smallest hash of its 40-byte grams, at the same place wherever the string
occurs. Only anchors are shuffled, with a hash of the bytes within reach (160 before, 200 after). Anchors that agree in
all of those bytes are covered as they stand; where an anchor has several surroundings, one copy of each comes together,
their right and left parts are sorted as suffixes - multikey quicksort by 8-byte keys to a shallow depth, then blind tries
for the groups with longer common prefixes - and the common prefixes of neighbours give, for each anchor, the outermost
200-byte strings around it that occur elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, carried, chunks, discard, mix, powers, saved, shared_dir, small_batches

carried(__name__)

SPAN = 200
GRAM = 40
BEFORE = SPAN - GRAM  # bytes before an anchor that a string holding it can reach
SHALLOW = 32  # bytes beyond the common gram that quicksort looks at
#: A gram with more surroundings than the first number is sorted in pieces: strings that begin o bytes before the anchor, o
#: from a to b, share its a bytes before and its SPAN - b bytes from there on, so anchors meet by these. Each step up the list
#: makes the ranges of o narrower, to single values.
CROWDS = ((0, BEFORE + 1), (20_000, 21), (1_000_000, 1))
SPREAD = 256  # parts over which the settled anchors of a gram are dealt
BATCH = 20_000  # surroundings that are sorted at once


# --- anchors ---------------------------------------------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of values[i : i + width] for every i that has them."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, gram hash, surroundings hash) of the anchors of a run of texts."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    back = powers(INVERSE, n + 1)
    grams = np.maximum(mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1]), np.uint64(1))
    least = _sliding(grams, BEFORE + 1, np.minimum)  # of the string that starts there
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least[row[: len(least)] != row[SPAN - 1 :][: len(least)]] = 0  # it crosses rows
    pad = np.zeros(BEFORE, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), BEFORE + 1, np.maximum)
    at = np.flatnonzero(most == grams[: len(most)])
    own = row[at]
    start, end = np.maximum(at - BEFORE, bounds[own]), np.minimum(at + SPAN, bounds[own + 1])
    around = mix((total[end] - total[start]) * back[start] + ((at - start) * 1000 + (end - at)).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return own, at - bounds[own], grams[at].view(np.int64), around.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of (d1, d2, text). Those whose surroundings occur twice in a run of texts are settled at once; only one of
    them goes on to meet the others of its gram, so a passage that fills the corpus sends few rows to its task."""
    for batch in batches:
        d1, d2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2"))
        for first, data, bounds in chunks(batch.column("text")):
            row, at, gram, around = anchors(data, bounds)
            if len(row):
                n = np.diff(bounds)[row]
                both = gram.view(np.uint64) ^ mix(around.view(np.uint64))
                _, one, same, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                settled = count[same] > 1
                pick = np.concatenate([np.arange(len(row)), one[count > 1]])
                spread = np.where(settled, 1 + (at + row) % SPREAD, 0)
                flags = np.concatenate([spread, np.zeros(int((count > 1).sum()), np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[pick], around[pick], d1[first + row[pick]], d2[first + row[pick]], at[pick].astype(np.int32), n[pick].astype(np.int32), flags)], [*COLUMNS, "spread"])


COLUMNS = ["gram", "around", "d1", "d2", "at", "n"]


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (gram, around). Those whose surroundings occur twice or more (covered), and, of grams with several
    surroundings, the first anchor of each (asked). Settled ones pass. Holds one row and the first anchor of the open gram."""
    carry: dict | None = None

    def rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 6), np.int64)
        covered = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, bool)
        asked = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([*(pa.array(table[:, i]) for i in range(6)), pa.array(covered), pa.array(asked)], [*COLUMNS, "covered", "asked"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in COLUMNS], axis=1)
        settled = batch.column("spread").to_numpy(zero_copy_only=False) > 0
        if settled.any():
            yield from rows([(t[settled], np.ones(int(settled.sum()), bool), np.zeros(int(settled.sum()), bool))])
            t = t[~settled]
        if not len(t):
            continue
        if carry:
            t = np.concatenate([carry["row"], t])
        new_gram = np.r_[True, t[1:, 0] != t[:-1, 0]]
        new_around = new_gram | np.r_[True, t[1:, 1] != t[:-1, 1]]
        again = np.r_[not new_around[1] if len(t) > 1 else False, ~new_around[1:]]
        again[:-1] |= ~new_around[1:]
        if carry:
            new_around[0], again[0] = carry["first_of_around"], again[0] | carry["again"]
        group = np.cumsum(new_gram) - 1
        several = np.bincount(group, weights=new_around & ~new_gram, minlength=group[-1] + 1) > 0
        out = []
        if carry and (carry["several"] or new_around[0] and carry["waiting"] is not None):
            several[0] = True
        if carry and several[0] and carry["waiting"] is not None:
            out.append((carry["waiting"], np.array([False]), np.array([True])))
            carry["waiting"] = None
        asked = new_around & several[group]
        closed = np.ones(len(t), bool)
        closed[-1] = False
        emit = closed & (again | asked)
        if emit.any():
            out.append((t[emit], again[emit], asked[emit]))
        if out:
            yield from rows(out)
        # the open gram: its first anchor waits while it has one surroundings only (asked, but not covered anew)
        open_first = np.flatnonzero(group == group[-1])[0]
        waiting = None
        if not several[-1]:
            if open_first == len(t) - 1 and not (carry and group[-1] == 0):
                waiting = None  # the held row itself is the first anchor
            elif carry and group[-1] == 0:
                waiting = carry["waiting"] if carry["waiting"] is not None else (t[:1] if len(t) > 1 and carry["first_of_around"] else None)
            else:
                waiting = t[open_first : open_first + 1]
        carry = {"row": t[-1:], "again": bool(again[-1]), "first_of_around": bool(new_around[-1]), "several": bool(several[-1]), "waiting": waiting}
    if carry and (carry["again"] or carry["several"] and carry["first_of_around"]):
        yield from rows([(carry["row"], np.array([carry["again"]]), np.array([carry["several"] and carry["first_of_around"]]))])


# --- suffix sorting --------------------------------------------------------------------------------------------------


class BlindTrie:
    """Orders different strings of equal length by inserting them one by one: an inner node holds only a byte position and
    its children by that byte, so a string is compared in full with one leaf only."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | int | None = None

    def insert(self, strings: list[bytes], i: int) -> None:
        s = strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):  # blind: bytes between the positions aren't looked at
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        differing = int.from_bytes(s) ^ int.from_bytes(strings[node])
        depth = len(s) - (differing.bit_length() + 7) // 8
        leaf = strings[node]
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            return
        made = (depth, {leaf[depth]: node, s[depth]: i})
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            elif node is not None:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
        return out


def multikey_quicksort(strings: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of strings (bytes) by (group, first `depth` bytes), and the segment of each place: rows of a group
    that agree in those bytes. In every round each open segment is split in three about the 8-byte key of its middle row;
    the part that equals it goes on with the next key, the others stay at theirs. All segments are split side by side."""
    order, segment = np.argsort(group, kind="stable"), np.sort(group)
    segment = np.cumsum(np.r_[False, segment[1:] != segment[:-1]])
    keys = -(-min(depth, strings.shape[1]) // 8)
    padded = np.zeros((len(strings), 8 * keys), np.uint8)
    padded[:, : min(depth, strings.shape[1])] = strings[:, : 8 * keys][:, : min(depth, strings.shape[1])]
    key = padded.view(">u8").astype(np.uint64)
    level = np.zeros(len(order), np.int64)  # keys in which a segment agrees
    while True:
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[starts, len(order)])
        open_ = np.flatnonzero(np.repeat((size > 1) & (level[starts] < keys), size))
        if not len(open_):
            return order, segment
        pivot = np.repeat(starts + size // 2, size)[open_]
        own, middle = key[order[open_], level[open_]], key[order[pivot], level[open_]]
        part = (own >= middle).astype(np.int64) + (own > middle)
        step = np.argsort(3 * segment[open_] + part, kind="stable")
        order[open_] = order[open_][step]
        part = part[step]
        level[open_] += part == 1
        parts = np.zeros(len(order), np.int64)
        parts[open_] = part
        both = 3 * segment + parts
        segment = np.cumsum(np.r_[False, both[1:] != both[:-1]])


def deep_shallow(strings: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows of strings (bytes) by (group, string): multikey quicksort to SHALLOW bytes, then a blind trie for
    each run of rows that are still equal."""
    order, segment = multikey_quicksort(strings, group, SHALLOW)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a > 1:
            members = order[a:b]
            equal: dict[bytes, list[int]] = {}
            for i in members:
                equal.setdefault(strings[i].tobytes(), []).append(i)
            rest, trie = list(equal), BlindTrie()
            for i in range(len(rest)):
                trie.insert(rest, i)
            order[a:b] = [j for i in trie.ordered() for j in equal[rest[i]]]
    return order


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix, row by row."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def outermost(group: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor (rows; group: its gram, or piece of one) the least and greatest o from lowest to highest (equal within
    a group) such that the string from o bytes before it also surrounds another anchor of its group; (1, 0) if none does.
    left: the bytes before it, nearest first; right: from it on."""
    n = len(group)
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    sides = []
    for strings, have in ((left, before), (right[:, GRAM:], after - GRAM)):
        order = deep_shallow(strings, group)
        same = group[order][1:] == group[order][:-1]
        lcp = np.zeros(n, np.int64)
        for a in range(0, n - 1, 50_000):
            b = min(a + 50_000, n - 1)
            i, j = order[a:b], order[a + 1 : b + 1]
            lcp[a + 1 : b + 1] = np.minimum(common_prefixes(strings[i], strings[j]), np.minimum(have[i], have[j]))
        lcp[1:][~same] = -1
        lcp[0] = -1
        sides.append((order, lcp))
    (by_left, lcp_left), (by_right, lcp_right) = sides
    found = np.zeros(n, bool)
    for o in range(int(lowest.min(initial=0)), int(highest.max(initial=-1)) + 1):
        c = np.empty(n, np.int64)
        c[by_left] = np.cumsum(lcp_left < o)
        e = np.empty(n, np.int64)
        e[by_right] = np.cumsum(lcp_right < SPAN - o - GRAM)
        both = c * (n + 1) + e
        step = np.argsort(both, kind="stable")
        equal = both[step][1:] == both[step][:-1]
        twice = np.zeros(n, bool)
        twice[step[1:][equal]] = twice[step[:-1][equal]] = True
        twice &= (before >= o) & (after >= SPAN - o) & (lowest <= o) & (o <= highest)
        low[twice & ~found] = o
        high[twice] = o
        found |= twice
    return low, high


PIECE = ["gram", "lo", "hi", "shared"]  # what anchors that meet agree in


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings with their gram's range width -> one row for each range [lo, hi] of o that they reach, with a hash of the
    bytes that all strings of the range share."""
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, BEFORE + SPAN)
        width, at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "at", "n"))
        for w in np.unique(width):
            for lo in range(0, BEFORE + 1, w):
                hi = min(lo + w - 1, BEFORE)
                rows = np.flatnonzero((width == w) & (at >= lo) & (n - at >= SPAN - hi))
                if not len(rows):
                    continue
                common = np.ascontiguousarray(raw[rows, BEFORE - lo : BEFORE + SPAN - hi])
                shared = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True) for x in common] if w <= BEFORE else [0] * len(rows)
                out = batch.drop_columns(["width"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([lo] * len(rows), pa.int32()), pa.array([hi] * len(rows), pa.int32()), pa.array(shared, pa.int64())], [*out.schema.names, "lo", "hi", "shared"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by PIECE: the stretches (d1, d2, first, last) that strings around the wanted ones cover. A piece of
    one o only holds equal strings, so it may be cut anywhere, one row staying for the next part."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        get = lambda c: table.column(c).to_numpy()
        at, n, wanted, lo, hi = (get(c) for c in ("at", "n", "wanted", "lo", "hi"))
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, BEFORE + SPAN)
        before, after = np.minimum(at, BEFORE), np.minimum(n - at, SPAN)
        keys = np.stack([get(c).astype(np.int64) for c in PIECE], axis=1)
        group = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(1)])
        low, high = outermost(group, np.ascontiguousarray(raw[:, :BEFORE][:, ::-1]), raw[:, BEFORE:], before.astype(np.int64), after.astype(np.int64), lo, hi)
        hit = wanted & (low <= high)
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(get("d1")[hit]), pa.array(get("d2")[hit]), pa.array((at[hit] - high[hit]).astype(np.int32)), pa.array((at[hit] - low[hit] + SPAN).astype(np.int32))], ["d1", "d2", "first", "last"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH:
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in PIECE]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(PIECE, last, strict=True):
                same &= table.column(c).to_numpy() == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last piece may go on
            if table.num_rows - cut >= BATCH and last[1] == last[2]:
                yield from solve(table)
                held, size = table.slice(table.num_rows - 1).combine_chunks().to_batches(), 1
            elif cut:
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
    if held:
        yield from solve(pa.Table.from_batches(held))


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, text, asked: list of (gram, at, wanted, width)) -> a row with the padded surroundings for each of asked. 255
    never occurs in UTF-8."""
    schema = pa.schema([("gram", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("wanted", pa.bool_()), ("bytes", pa.binary()), ("width", pa.int32())])
    for batch in batches:
        for d1, d2, text, asked in zip(*(batch.column(c) for c in ("d1", "d2", "text", "asked")), strict=True):
            s = text.as_py()
            padded = b"\xff" * BEFORE + s + b"\xff" * SPAN
            rows = asked.as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["gram"] for r in rows], pa.int64()), pa.array([d1.as_py()] * len(rows), pa.int64()), pa.array([d2.as_py()] * len(rows), pa.int64()), pa.array([r["at"] for r in rows], pa.int32()), pa.array([len(s)] * len(rows), pa.int32()), pa.array([r["wanted"] for r in rows], pa.bool_()), pa.array([padded[r["at"] : r["at"] + BEFORE + SPAN] for r in rows], pa.binary()), pa.array([r["width"] for r in rows], pa.int32())],
                schema=schema,
            )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, text, spans: list of (first, last)) -> removed bytes, runs, digest and bytes of the rest."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            s = np.frombuffer(text.as_buffer(), np.uint8)
            rows = np.array([(r["first"], r["last"]) for r in spans.as_py()], np.int64).reshape(-1, 2)
            step = np.zeros(len(s) + 1, np.int64)
            np.add.at(step, rows[:, 0], 1)
            np.add.at(step, rows[:, 1], -1)
            gone = np.cumsum(step)[:-1] > 0
            rest = s[~gone].tobytes()
            out.append((int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["d1", "d2", "n_removed", "n_spans", "kept_sha256", "kept"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        mask = []
        for pair in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True):
            mask.append(pair not in seen)
            seen.add(pair)
        yield batch.filter(pa.array(mask, pa.bool_()))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False, crowds=CROWDS) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes).

    Every byte that lies in a 200-byte string that also starts elsewhere, in the same text or another, is removed. Null
    texts count as empty; texts of fewer than 200 bytes lose nothing. Rows of equal text, if it has 200 bytes, lose all of
    it. Very long texts are read whole. Null keys are keys. An empty table gives no rows. Other columns aren't read.
    """
    with small_batches(docs.sparkSession):
        return _removals(docs, key, text, with_kept, crowds)


def _removals(docs: DataFrame, key: str, text: str, with_kept: bool, crowds) -> DataFrame:
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    half = lambda i: F.conv(F.substring("m", i, 16), 16, -10).cast("bigint")
    named = docs.select(F.col(key).alias("key"), body.alias("text")).withColumn("m", F.md5("text"))
    named = named.select("key", "text", half(1).alias("d1"), half(17).alias("d2"), F.length("text").cast("long").alias("n_bytes"))
    rows = saved(named.select("key", "d1", "d2", "n_bytes", F.sha2("text", 256).alias("whole")), "texts")
    long = named.where(F.col("n_bytes") >= SPAN).select("d1", "d2", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_texts = long.mapInArrow(_once, long.schema).repartition(parts, "d1", "d2").mapInArrow(_once, long.schema)
    name = f"texts_{uuid.uuid4().hex}"
    kept_texts.write.bucketBy(parts, "d1", "d2").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    texts.saved_at = f"{shared_dir(spark)}/{name}"

    schema = "gram bigint, around bigint, d1 bigint, d2 bigint, at int, n int, spread int"
    found = texts.mapInArrow(_anchor_rows, schema).repartition("gram", "spread").sortWithinPartitions("gram", "around")
    repeated = saved(found.mapInArrow(_sorted_out, "gram bigint, around bigint, d1 bigint, d2 bigint, at bigint, n bigint, covered boolean, asked boolean"), "anchors")
    whole = repeated.where("covered").select("d1", "d2", F.greatest(F.col("at") - BEFORE, F.lit(0)).cast("int").alias("first"), F.least(F.col("at") + SPAN, "n").cast("int").alias("last"))

    asked = repeated.where("asked").select("gram", "d1", "d2", F.col("at").cast("int").alias("at"), (~F.col("covered")).alias("wanted"))
    width = F.lit(None).cast("int")
    for least, w in crowds:
        width = F.when(F.col("count") > least, F.lit(w)).otherwise(width)
    crowded = saved(asked.groupBy("gram").count().where(F.col("count") > crowds[1][0]).select("gram", width.alias("width")), "crowded")
    asked = asked.join(crowded, "gram", "left").select("d1", "d2", F.struct("gram", "at", "wanted", F.coalesce("width", F.lit(crowds[0][1])).alias("width")).alias("a"))
    asked = asked.groupBy("d1", "d2").agg(F.collect_list("a").alias("asked"))
    fields = "gram bigint, d1 bigint, d2 bigint, at int, n int, wanted boolean, bytes binary"
    surroundings = texts.join(asked, ["d1", "d2"]).mapInArrow(_with_bytes, f"{fields}, width int").mapInArrow(_pieces, f"{fields}, lo int, hi int, shared bigint")
    covers = surroundings.repartition(*PIECE).sortWithinPartitions(*PIECE).mapInArrow(_covered, "d1 bigint, d2 bigint, first int, last int")
    spans = whole.unionByName(covers).groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    cut = texts.join(spans, ["d1", "d2"]).mapInArrow(_kept, "d1 bigint, d2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = saved(cut if with_kept else cut.drop("kept"), "cut")
    spark.sql(f"DROP TABLE {name}")
    discard(texts, repeated, crowded)

    copies = saved(rows.where(F.col("n_bytes") >= SPAN).groupBy("d1", "d2").agg((F.count(F.lit(1)) > 1).alias("copied")).where("copied"), "copies")
    joined = rows.join(cut, ["d1", "d2"], "left").join(copies, ["d1", "d2"], "left")
    gone = F.coalesce("copied", F.lit(False))
    return joined.select(
        F.col("key").alias(key), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"), *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
