"""Helpers that the training-data operators share: stored intermediates, bindings inside expressions, word hashing."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def carried(module: str) -> None:
    """Send the module's functions to the executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


carried(__name__)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir). Where it is unset, a local master gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _local_dirs[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what saved() wrote, once no frame that is still wanted reads it."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of so many rows at most, for work that runs after small_batches has ended."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column of df (in any case) is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


FAN_IN = 256  # tables that one task adds up at most


def summed_table(partials: DataFrame, slices: int, dtype: type) -> DataFrame:
    """partials (slice, part): each task's tables of numbers, cut into slices and compressed -> (slice, part): their sums,
    in the wider type of dtype. With many tasks the sums are taken in a tree, FAN_IN tables a task, so no task reads all."""
    wide = np.uint64 if np.issubdtype(dtype, np.integer) else np.float64

    def add(kind: type) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(zlib.decompress(raw), kind)
                    if i in sums:
                        sums[i] += part
                    else:
                        sums[i] = part.astype(wide)
            for i, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "part"])

        return run

    groups, kind = -(-partials.rdd.getNumPartitions() // FAN_IN), dtype
    while groups > 1:
        partials = partials.repartition(slices * groups, "slice", F.pmod(F.spark_partition_id(), F.lit(groups))).mapInArrow(add(kind), "slice int, part binary")
        groups, kind = -(-groups // FAN_IN), wide
    return partials.repartition(slices, "slice").mapInArrow(add(kind), "slice int, part binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once for body; without it Catalyst may inline the value into a lambda and evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    names = {}
    for k in keys:
        name = f"right_{k}"
        while name in left.columns or name in right.columns or name in names.values():
            name = f"_{name}"
        names[k] = name
    right = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(names[k]))
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*names.values())


# --- word hashing of Arrow string columns, a few hundred thousand bytes at a time -----------------------------------

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}

LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out, size = np.ones(1, np.uint64), 1
        while size < n:
            step = np.uint64(pow(base, size, 1 << 64))
            out, size = np.concatenate([out, out * step]), size * 2
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a multiply-xorshift finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) of runs of rows with about limit bytes; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of rows, and each row's bounds among them. separators: 256 flags. head: hash only as
    many first bytes of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    last = np.minimum(last, first + head) if head else last
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    h = (total[last] - total[first]) * powers(INVERSE, len(data))[first]
    return mix(h + (last - first).astype(np.uint64)), np.searchsorted(first, bounds)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; fewer words make one shingle of all of them, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h + words[i : i + m]) * np.uint64(BASE)
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(n))
