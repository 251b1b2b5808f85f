"""Reading and writing runs, metrics, thresholds and provenance."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajscreen.functions.lineage import cut
from trajscreen.functions.workers import carried

carried(__name__)

TASKS = 100_000  # tasks of an ingest; more ranges share them
METRICS = "type string, sev int, phase string, detector string, auroc double, lo double, hi double, tpr double"


def load_split(spark: SparkSession, path: str, split: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A split's table (folder <path>/<split>) within [start, stop) of sim; the range is pushed to the scan."""
    df = spark.read.parquet(f"{path}/{split}")
    if start is not None:
        df = df.where(F.col("sim") >= start)
    return df if stop is None else df.where(F.col("sim") < stop)


def write_runs(df: DataFrame, table: str, buckets: int = 4096, keys: Sequence[str] = ("sim",), order: Sequence[str] = ("sim", "node", "frame")) -> None:
    """df as a catalog table in buckets by keys, one sorted file a bucket. Lags by (sim, node), groups by sim and more, and, with
    spark.sql.requireAllClusterKeysForCoPartition false, joins of tables with as many buckets on sim and more then need no
    further exchange. A bucket is one task's work: take as many as make it fit, a run is never split."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*order).format("parquet").saveAsTable(table)


def read_metrics(spark: SparkSession, path: str, schema: str = METRICS) -> DataFrame:
    """A metrics CSV with a header after '#' lines."""
    return spark.read.option("comment", "#").option("header", True).schema(schema).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Results, nested ones too, as lines of JSON."""
    df.write.mode("overwrite").json(path)


def write_thresholds(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_provenance(df: DataFrame, meta: Mapping[str, str]) -> DataFrame:
    """df with a meta_<name> column for each entry."""
    return df.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()})


def assert_meta(df: DataFrame, **expected: str) -> None:
    """Raises unless every row has the expected provenance."""
    wrong = None
    for k, v in expected.items():
        differs = ~F.col(f"meta_{k}").eqNullSafe(F.lit(v))
        wrong = differs if wrong is None else wrong | differs
    if wrong is not None and not df.where(wrong).isEmpty():
        raise ValueError(f"the records are not of {expected}")


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs whose keys aren't done."""
    return jobs.join(done, list(keys), "left_anti")


# --- raw tensor records ----------------------------------------------------------------------------------------------


#: Where an example message nests (features, entry, feature, list of bytes), and where it has names and values: fixed
#: field numbers of the public message format.
NESTED = {(1,), (1, 1), (1, 1, 2), (1, 1, 2, 1)}
NAME, VALUE = (1, 1, 1), (1, 1, 2, 1, 1)


def _number(buffer: memoryview, at: int) -> tuple[int, int]:
    """A base-128 number, lowest digits first, and where it ends."""
    end = at
    while buffer[end] >= 128:
        end += 1
    return sum((digit & 127) << (7 * i) for i, digit in enumerate(buffer[at : end + 1])), end + 1


def _example(buffer: memoryview, at: int, end: int) -> dict[str, bytes]:
    """The bytes features of a message, in one pass over its offsets; path and ends are those of the open messages."""
    found: dict[str, bytes] = {}
    name, path, ends = "", (), [end]
    while at < end:
        while at >= ends[-1]:
            path, _ = path[:-1], ends.pop()
        tag, at = _number(buffer, at)
        here = (*path, tag >> 3)
        if tag & 7 != 2:
            at = {0: lambda i: _number(buffer, i)[1], 1: lambda i: i + 8, 5: lambda i: i + 4}[tag & 7](at)
            continue
        size, at = _number(buffer, at)
        if here in NESTED:
            path = here
            ends.append(at + size)
            continue
        if here == NAME:
            name = bytes(buffer[at : at + size]).decode()
        elif here == VALUE:
            found[name] = bytes(buffer[at : at + size])
        at += size
    return found


#: Bytes of a record around its message: 8 of length and 4 of checksum before it, 4 of checksum after it.
BEFORE, AFTER = 12, 4
PIECE = 64 << 20  # bytes of whole records that are one row of the scan
RUN = "sim bigint, frame int, node int, x double, y double, z double, node_type int, rx double, ry double, rz double"


def _opened(path: str) -> pa.NativeFile:
    """A file by its Hadoop path, for reads at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return system.open_input_file(inner)


def framed_features(source: pa.NativeFile, at: int, records: int) -> Iterator[dict[str, bytes]]:
    """The bytes features of so many framed records from a place on; one record is held at a time."""
    source.seek(at)
    for _ in range(records):
        size = int.from_bytes(source.read(BEFORE)[:8], "little")
        message = memoryview(source.read(size + AFTER))
        yield _example(message, 0, size)


def record_ranges(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, start, records, first): ranges of whole records of about `piece` bytes, or of one longer record, in framed record
    files; first numbers records over all files in the order of their names. Files are read by their headers only, one
    task a file, so a file may have any size. Empty files have no ranges; a file that ends within a record is an error."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                found, start, at, n = [], 0, 0, 0
                with _opened(name) as source:
                    end = source.size()
                    while at < end:
                        source.seek(at)
                        at += BEFORE + int.from_bytes(source.read(8), "little") + AFTER
                        n += 1
                        if at > end:
                            raise ValueError(f"{name} ends within a record")
                        if at - start >= piece or at == end:
                            found.append((start, n))
                            start, n = at, 0
                starts, counts = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["path", "start", "records"])

    files = spark.read.format("binaryFile").load(path).select("path")
    ranges = cut(files.mapInArrow(indexed, "path string, start bigint, records bigint"))
    until = lambda w: F.coalesce(F.sum("records").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranges.groupBy("path").agg(F.sum("records").alias("records")).select("path", until(Window.orderBy("path")).alias("before"))
    own = ranges.withColumn("own", until(Window.partitionBy("path").orderBy("start")))
    return own.join(before, "path").select("path", "start", "records", (F.col("before") + F.col("own")).alias("first"))


def ingest_tensors(spark: SparkSession, path: str, meta: Mapping[str, Mapping], limit: int | None = None, piece: int = PIECE) -> DataFrame:
    """(sim, frame, node, x, y, z, node_type, rx, ry, rz) of the runs in framed record files. meta: by feature its dtype,
    shape and whether it is static (its first row holds). stress is never read. sim numbers the runs of all files, 0, 1, ..,
    in the order of file names and places; limit: the first so many of them. Ranges of whole records are dealt over
    tasks, so one long file is many tasks' work; ranges beyond the limit aren't read."""
    decode = {k: (np.dtype(v["dtype"]), tuple(v["shape"])) for k, v in meta.items() if k != "stress"}

    def run(features: dict[str, bytes], sim: int) -> pa.RecordBatch:
        get = lambda f: np.frombuffer(features[f], decode[f][0]).reshape(decode[f][1])
        world, rest, kind = get("world_pos"), get("mesh_pos"), get("node_type")
        rest, kind = rest[0] if rest.ndim == 3 else rest, (kind[0] if kind.ndim == 3 else kind)[:, 0]
        t, n, _ = world.shape
        cols = [np.full(t * n, sim), np.repeat(np.arange(t), n).astype(np.int32), np.tile(np.arange(n), t).astype(np.int32), *(world[:, :, i].ravel().astype(np.float64) for i in range(3)), np.tile(kind, t).astype(np.int32), *(np.tile(rest[:, i], t).astype(np.float64) for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["sim", "frame", "node", "x", "y", "z", "node_type", "rx", "ry", "rz"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["path"]) as source:
                    for k, features in enumerate(framed_features(source, r["start"], r["records"])):
                        yield run(features, r["first"] + k)

    ranges = record_ranges(spark, path, piece)
    if limit is not None:
        ranges = ranges.where(F.col("first") < limit).withColumn("records", F.least("records", F.lit(limit) - F.col("first")))
    ranges = cut(ranges)
    return ranges.repartition(min(max(ranges.count(), 1), TASKS), "path", "start").mapInArrow(rows, RUN)
