"""N-gram Jaccard self-join by prefix filtering under several global token orders.

A document is the set of its word n-grams (tokens, 64-bit hashes). Documents of equal sets are one class. Two sets with
Jaccard similarity t or more share a token among the first n - ceil(t * n) + 1 of each, whatever total order the tokens
are put in. All orders begin with a frequency class from a table of counts over all documents (so common tokens come last;
the table's size follows the corpus) and go on by a hash of their own. Order 0 makes the candidates by a join on prefix
tokens; length and a parity bitmap (its differing bits are at most the differing tokens) drop most. On the list of pairs
that are left the prefixes of all other orders are intersected, kept with each set as 16-bit signatures (equal tokens have
equal signatures, so no pair is lost); sets are fetched for those pairs only that share a token under every order.

Only the components are asked for, so a bucket first links its members to one leader; later rounds compare only
members of different components, first each with a few others of its bucket, then with its likeliest partner, then all
that is left. So groups of copies, near or less near, aren't expanded into all pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from .common import FAN_IN, LOWER_TABLE, SPACES, carried, chunks, discard, free_name, mix, saved, shingle_hashes, small_batches, summed_table, word_hashes

carried(__name__)

#: Index bits of the table of counts: as many cells as the texts have bytes / CELL_BYTES, between these bounds (16 to 64 MB a task).
TABLE_BITS = (16, 26)
CELL_BYTES = 12
SLICE_BITS = 20  # cells of a slice of the table
MOST = 255  # a task counts a cell up to this
#: Shares of the counted tokens at which the frequency classes part; finer where prefixes lie.
SHARES = (0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ORDERS = 3
LONGS = 8  # 64-bit words of a parity bitmap
#: (tokens, 64-bit words): sets of so many tokens or more have a wider bitmap besides, the last that fits.
WIDER = ((800, 64), (6000, 512))
SEEDS = np.array([0x51ED270B7A1F39C5, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
SALTED = 1000  # pairs that are verified together with one copy of their leader's set
AHEAD = 8  # members of a bucket that each is held against in the second round
PIECE = 500  # members of a bucket that one task holds against each other
KEPT = 3  # and those of them, by all its buckets, that it is verified against
BLOOM_BITS = 23
LARGEST_BLOOM = 28  # 32 MB; a fuller table lets more sets through to the exact join


def token_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, data, bounds in chunks(texts):
        h, at = word_hashes(LOWER_TABLE[data], bounds, SPACES)
        for i in range(len(bounds) - 1):
            yield np.unique(shingle_hashes(h[at[i] : at[i + 1]], n))


class Classes:
    """Frequency classes of the cells of the table of counts, two to a byte."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        cell = (tokens >> self.shift).astype(np.int64)
        return (self.packed[cell >> 1] >> ((cell & 1) * 4).astype(np.uint8)) & 15


def ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens of the given frequency classes under an order; they are cut to 48 bits in the order's hash."""
    return (classes.astype(np.uint64) << np.uint64(56)) | (mix((tokens >> np.uint64(16)) ^ SEEDS[order]) >> np.uint64(8))


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The tokens that come first under an order."""
    n = len(tokens)
    p = n - (percent * n + 99) // 100 + 1
    if p >= n:
        return tokens
    rank = ranks(tokens, classes, order)
    return tokens[rank <= np.partition(rank, p - 1)[p - 1]]


def frequency_classes(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """What Classes is made of: classes (0 rare to 15 common) of the cells of the table of token counts over all documents, parted at SHARES of all
    counts. Tasks count into a table of fixed size; slices of the tables are summed in a tree, and only classes of half a
    byte a cell reach the driver."""
    size = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(size / CELL_BYTES + 1)), *TABLE_BITS))
    slices = max(1, (1 << bits) >> SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for s in token_sets(batch.column(0), n):
                cell = s >> np.uint64(64 - bits)
                now = table[cell]
                table[cell] = now + (now < MOST)  # cells of one document may coincide: then counted once
        for i, part in enumerate(np.split(table, slices)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "part"])

    counts = saved(summed_table(docs.mapInArrow(count, "slice int, part binary"), slices, np.uint8), "counts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                value, cells = np.unique(np.minimum(np.frombuffer(zlib.decompress(raw), np.uint64), 1 << 16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(cells.astype(np.int64))], ["value", "cells"])

    found = counts.mapInArrow(spread, "value bigint, cells bigint").groupBy("value").agg(F.sum("cells")).orderBy("value").collect()  # 65,537 rows at most
    value = np.array([r[0] for r in found], np.float64)
    mass = np.cumsum(value * [r[1] for r in found])
    parted = np.unique(value[np.searchsorted(mass, np.array(SHARES) * mass[-1])]) if len(value) and mass[-1] else np.zeros(0)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.searchsorted(parted, np.frombuffer(zlib.decompress(raw), np.uint64).astype(np.float64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress((c[::2] | c[1::2] << 4).tobytes(), 1)], pa.binary())], ["slice", "part"])

    packed = np.zeros(1 << (bits - 1), np.uint8)
    for r in counts.mapInArrow(classed, "slice int, part binary").toLocalIterator():  # slices of a fixed size, 32 MB in all at most
        part = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
        packed[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    discard(counts)
    return packed, bits


def parity_bitmap(tokens: np.ndarray, longs: int) -> np.ndarray:
    """Bit i: whether an odd number of tokens falls on it."""
    odd = np.bincount(((tokens >> np.uint64(20)) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(n: int, percent: int, classes) -> Callable:
    """(key, kh, text) -> (key, kh, cls, n, bitmap, wide, others, prefix); the last four only once a class and task. others:
    for each further order the 16-bit signatures of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known = Classes(*classes.value)
        for batch in batches:
            cls, size, maps, wides, others, prefixes = [], [], [], [], [], []
            for s in token_sets(batch.column("text"), n):
                size.append(len(s))
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                cls.append(digest)
                if digest is None or digest in seen:
                    maps.append(None)
                    wides.append(None)
                    others.append(None)
                    prefixes.append(None)
                    continue
                seen.add(digest)
                maps.append(parity_bitmap(s, LONGS))
                wides.append(parity_bitmap(s, [w for least, w in WIDER if len(s) >= least][-1]) if len(s) >= WIDER[0][0] else None)
                rare = known.of(s)
                others.append([np.unique(prefix(s, rare, k, percent).astype(np.uint16)).view(np.int16) for k in range(1, ORDERS)])
                prefixes.append(prefix(s, rare, 0, percent).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kh"), pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(maps, longs), pa.array(wides, longs), pa.array(others, pa.list_(pa.list_(pa.int16()))), pa.array(prefixes, longs)], ["key", "kh", "cls", "n", "bitmap", "wide", "others", "prefix"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (token, n, sid): those of tokens that occur twice or more, with the token's first sid."""
    token, leader, waiting = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, n, sid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if waiting is not None:
            t, n, sid = (np.concatenate([w, x]) for w, x in zip(waiting, (t, n, sid), strict=True))
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        first = sid[starts][np.cumsum(np.r_[True, t[1:] != t[:-1]]) - 1]
        if token is not None:
            first[t == token] = leader
        several = np.r_[False, t[1:] == t[:-1]] | np.r_[t[1:] == t[:-1], False]
        if token is not None:
            several |= t == token
        # the last posting waits: whether its token goes on is not known yet
        out = several.copy()
        out[-1] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(n[out]), pa.array(sid[out]), pa.array(first[out])], ["token", "n", "sid", "leader"])
        if several[-1]:
            token, leader = t[-1], first[-1]
        else:
            token = leader = None
        waiting = (t[-1:], n[-1:], sid[-1:])
    if waiting is not None and token is not None:
        yield pa.RecordBatch.from_arrays([pa.array(waiting[0]), pa.array(waiting[1]), pa.array(waiting[2]), pa.array([leader], pa.int64())], ["token", "n", "sid", "leader"])


def _differing(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ."""
    out = None
    for i in range(LONGS):
        bits = F.bit_count(F.col(f"{a}.bitmap")[i].bitwiseXOR(F.col(f"{b}.bitmap")[i]))
        out = bits if out is None else out + bits
    return out


def _close(a: str, b: str, percent: int) -> Column:
    """What length and bitmaps allow."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differing(a, b) * (100 + percent) <= (100 - percent) * (n + m))


def _close_when_wide(a: str, b: str, percent: int) -> Column:
    """The same by the wider bitmaps, where both have one of equal width."""
    wide = F.aggregate(F.zip_with(F.col(f"{a}.wide"), F.col(f"{b}.wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    unlike = F.coalesce(F.size(f"{a}.wide") != F.size(f"{b}.wide"), F.lit(True)) | F.col(f"{a}.wide").isNull() | F.col(f"{b}.wide").isNull()
    return unlike | (wide * (100 + percent) <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _shared_in_all(a: str, b: str) -> Column:
    """Whether the prefixes share a token (by its signature) under every further order."""
    return F.forall(F.arrays_zip(F.col(f"{a}.others").alias("p"), F.col(f"{b}.others").alias("q")), lambda z: F.arrays_overlap(z["p"], z["q"]))


def _wanted(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """Bit table that holds the given key hashes, sixteen bits for each as far as LARGEST_BLOOM goes, and the logarithm of its size.
    The tasks' tables are put together in a tree, FAN_IN of them a task."""
    bits = min(max(BLOOM_BITS, int(hashes.count() * 16 - 1).bit_length()), LARGEST_BLOOM)

    def row(table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            held[mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)] = True
        yield row(np.packbits(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held |= np.frombuffer(zlib.decompress(raw), np.uint8)
        yield row(held)

    tables = hashes.mapInArrow(fill, "bits binary")
    count = tables.rdd.getNumPartitions()
    while count > 1:
        count = -(-count // FAN_IN)
        tables = tables.repartition(count, F.pmod(F.spark_partition_id(), F.lit(count))).mapInArrow(merge, "bits binary")
    found = np.zeros(1 << bits >> 3, np.uint8)
    for r in tables.collect():  # one row
        found |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return found, bits


def _sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """cls and token set (48 bits a token) of the documents whose key hash is in wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        table, bits = wanted.value
        for batch in batches:
            h = mix(batch.column("kh").to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)
            held = (table[(h >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (h & np.uint64(7)).astype(np.uint8))) & 1
            cls, sets = [], []
            for s in token_sets(batch.column("text").filter(pa.array(held.astype(bool))), n):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if digest and digest not in seen:
                    seen.add(digest)
                    cls.append(digest)
                    sets.append(s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "tokens"])

    return docs.select("kh", "text").mapInArrow(run, "cls binary, tokens binary")


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _verify(percent: int) -> Callable:
    """Rows sorted by (leader, salt, b), the leader's own set first (b null): the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = own = None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens"), strict=True):
                s = _unpacked(raw.as_buffer().to_pybytes())
                if b is None:
                    leader, own = a, s
                    continue
                if a != leader:
                    raise ValueError("a pair came without its leader's set")
                same = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * same >= percent * (len(own) + len(s) - same):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _neighbours(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, of different components: in each bucket, put in an order of its own, every member
    is held against the few that follow (in large buckets, of its piece); each keeps its likeliest. Linear in the buckets' rows, and in a large group of
    partly similar sets enough to join nearly all that belongs together."""
    rest = rest.withColumn("piece", F.pmod(F.xxhash64("sid"), F.ceil(F.col("members") / PIECE)))
    order = Window.partitionBy("token", "piece").orderBy(F.xxhash64("token", "sid"))
    ahead = F.array(*[F.lead(F.struct("sid", "component", "n", "bitmap"), k).over(order) for k in range(1, AHEAD + 1)])

    def differing(x: Column) -> Column:
        return sum((F.bit_count(x["bitmap"][i].bitwiseXOR(F.col("bitmap")[i])) for i in range(1, LONGS)), F.bit_count(x["bitmap"][0].bitwiseXOR(F.col("bitmap")[0])))

    def likely(x: Column) -> Column:
        n = F.col("n")
        return x.isNotNull() & (x["component"] != F.col("component")) & (100 * F.least(n, x["n"]) >= percent * F.greatest(n, x["n"])) & (differing(x) * (100 + percent) <= (100 - percent) * (n + x["n"]))

    found = rest.withColumn("ahead", ahead).select("sid", F.explode(F.transform(F.filter("ahead", likely), lambda x: F.struct(differing(x).alias("d"), x["sid"].alias("other")))).alias("p"))
    best = found.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("p")), 1, KEPT).alias("ps")).select("sid", F.explode("ps").alias("p"))
    return best.select(F.least("sid", "p.other").alias("a"), F.greatest("sid", "p.other").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component: its smallest node. Large-star and small-star rounds:
    every node hands its larger, then its smaller neighbours to the smallest one, until nothing changes."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(now, large)
        now = after
    found = saved(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(now)
    return found


def _labelled(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, cls, n) of each row of docs, and (cls, component, component_id) of each class. Both are stored, and all else is
    deleted as soon as it has been read for the last time."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("kh"), F.col(text).cast("binary").alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(rows.select("text"), words))
    kind = dict(docs.dtypes)[key]
    described = saved(rows.mapInArrow(_described(words, percent, classes), f"key {kind}, kh bigint, cls binary, n bigint, bitmap array<bigint>, wide array<bigint>, others array<array<smallint>>, prefix array<bigint>"), "described")
    sets = described.where("prefix is not null").groupBy("cls").agg(F.first(F.struct("kh", "n", "bitmap", "wide", "others", "prefix")).alias("s")).select("cls", "s.*")
    sets = saved(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    slim = saved(described.select("key", "cls", "n"), "slim")
    discard(described)
    postings = sets.select("sid", "n", F.explode("prefix").alias("token")).select("token", "n", "sid")
    shared = postings.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(_buckets, "token bigint, n bigint, sid bigint, leader bigint")
    shared = saved(shared, "buckets")
    info = sets.select("sid", "n", "bitmap", "kh", "cls")

    def linked(candidates: DataFrame, name: str) -> DataFrame:
        x, y = (sets.select("sid", "n", "wide", "others").alias(i) for i in "xy")
        pairs = candidates.alias("p").join(y, F.col("p.b") == F.col("y.sid")).join(x, F.col("p.a") == F.col("x.sid"))
        pairs = saved(pairs.where(_close_when_wide("x", "y", percent) & _shared_in_all("x", "y")).select("a", "b"), f"{name}-pairs")
        members = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        asked = saved(info.join(members, "sid").select("sid", "cls", "kh"), f"{name}-members")
        wanted = spark.sparkContext.broadcast(_wanted(asked.select("kh")))
        held = saved(_sets(rows, words, wanted).join(asked, "cls").groupBy("sid").agg(F.first("tokens").alias("tokens")), f"{name}-sets")
        salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
        leaders = held.withColumnRenamed("sid", "a").join(salts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "tokens")
        salted = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
        others = salted.join(held.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "tokens")
        ordered = leaders.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        links = saved(ordered.mapInArrow(_verify(percent), "a bigint, b bigint"), f"{name}-links")
        discard(pairs, asked, held)
        wanted.destroy()
        return links

    def opened(members: DataFrame) -> DataFrame:
        """Tokens whose bucket has members of several components, with the number of its members."""
        return members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("token", "members")

    stars = shared.where("sid <> leader").select("leader", "sid").distinct().alias("p")
    stars = stars.join(info.alias("y"), F.col("p.sid") == F.col("y.sid")).join(info.alias("x"), F.col("p.leader") == F.col("x.sid"))
    star_links = linked(stars.where(_close("x", "y", percent)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")), "star")
    grouped = components(star_links)

    labelled = shared.join(grouped.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", F.coalesce("component", "sid").alias("component"))
    first_rest = saved(labelled.join(opened(labelled), "token").join(info.select("sid", "n", "bitmap"), "sid"), "open-buckets")
    discard(shared, grouped)
    near = saved(_neighbours(first_rest, percent), "neighbours")
    near_links = linked(near, "neighbour")
    links = saved(star_links.unionByName(near_links), "links")
    discard(near, star_links, near_links)
    grouped = components(links)
    again = first_rest.drop("component", "members").join(grouped.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    rest = saved(again.join(opened(again), "token"), "open-buckets")
    discard(first_rest, grouped)
    across = (F.col("x.token") == F.col("y.token")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component"))
    crossing = rest.alias("x").join(rest.alias("y"), across & _close("x", "y", percent)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), _differing("x", "y").alias("d"))
    crossing = saved(crossing.distinct(), "crossing")
    discard(rest)
    # the likeliest partner of each member first: that joins most of what is one component, and leaves few pairs between
    best = crossing.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")).select("a", "b").union(crossing.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b")).distinct()
    best = saved(best, "best")
    best_links = linked(best, "near")
    more = saved(links.unionByName(best_links), "links")
    discard(links, best_links)
    grouped = components(more)
    of = lambda side: grouped.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    left = crossing.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    left = left.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")
    last = linked(left, "cross")
    discard(crossing, best, grouped)
    grouped = components(more.unionByName(last))
    discard(more, last)

    of_set = sets.select("cls", "sid").join(grouped.withColumnRenamed("node", "sid"), "sid", "left").select("cls", F.coalesce("component", "sid").alias("component"))
    of_set = saved(of_set, "set-components")
    discard(sets, grouped)
    named = slim.where("cls is not null").groupBy("cls").agg(F.min("key").alias("k")).join(of_set, "cls").groupBy("component").agg(F.min("k").alias("component_id"))
    ids = saved(of_set.join(named, "component").select("cls", "component", "component_id"), "set-ids")
    discard(of_set)
    classes.destroy()
    return slim, ids


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key reachable by links of similarity
    percent / 100 or more, its own included).

    Texts are lower-cased (A-Z), words lie between ASCII spaces; a text of fewer than `words` words has one shingle, a
    null text or one without words none and no links. Rows of equal sets are linked. Null keys count as rows; a
    component of null keys alone has the id null. Repeated rows give repeated rows. Long texts are processed whole. An
    empty table gives no rows. Columns other than key and text aren't read.
    """
    with small_batches(docs.sparkSession):
        slim, ids = _labelled(docs, key, text, words, percent)
    return slim.join(ids.select("cls", "component_id"), "cls", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def _with_class(docs: DataFrame, text: str, n: int, name: str) -> DataFrame:
    """docs with one more column: the class of each row's text, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in token_sets(batch.column(batch.num_columns - 1), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cls, pa.binary())], batch.schema.names)

    rows = docs.withColumn(name, F.col(text).cast("binary"))
    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest key, and among different texts of that key of
    the smallest class; null keys come last. Rows without shingles all stay, whatever their keys. Columns of docs may have
    any names. Very long texts are processed whole; an empty table gives no rows."""
    own_name, their, first = free_name(docs, "class"), free_name(docs, "dedup_key"), free_name(docs, "first_class")
    again_name = free_name(docs, "again_key")
    with small_batches(docs.sparkSession):
        slim, ids = _labelled(docs, key, text, words, percent)
        found = slim.join(ids, "cls", "left")
        again = saved(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(their)).where(F.col(their) > 1).select(F.col(key).alias(again_name)), "repeated")
        firsts = found.where(F.col("cls").isNull() | F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias(their)).distinct()
        kept = docs.join(firsts, F.col(key) == F.col(their), "left_semi")
        unnamed, repeated = docs.where(F.col(key).isNull()), docs.join(again, F.col(key) == F.col(again_name), "left_semi")
        if again.isEmpty():
            if unnamed.isEmpty():
                return kept
            repeated = unnamed
        else:
            kept, repeated = kept.join(again, F.col(key) == F.col(again_name), "left_anti"), repeated.unionByName(unnamed)
        # a key of several rows, or none, doesn't tell which of them is meant: their own classes do
        repeated = saved(_with_class(repeated, text, words, own_name), "repeated-classes")
    least = found.where(F.col("cls").isNotNull() & F.col("key").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("cls", "component_id")).alias("m"))
    least = least.select(F.col("m.cls").alias(first), F.col("m.component_id").alias(their))
    own = repeated.where(F.col(own_name).isNotNull()).dropDuplicates([key, own_name])
    own = own.join(least, (F.col(own_name) == F.col(first)) & F.col(key).eqNullSafe(F.col(their)), "left_semi")
    return kept.unionByName(own.drop(own_name)).unionByName(repeated.where(F.col(own_name).isNull()).drop(own_name))
