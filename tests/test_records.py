import struct

import numpy as np
import pytest

from trajscreen.sources import tables

T, N = 3, 4
META = {"world_pos": {"dtype": "f4", "shape": (T, N, 3)}, "mesh_pos": {"dtype": "f4", "shape": (1, N, 3)}, "node_type": {"dtype": "i4", "shape": (1, N, 1)}, "stress": {"dtype": "f4", "shape": (1,)}}


def field(number, payload):
    size, digits = len(payload), b""
    while size >= 128:
        digits += bytes([size & 127 | 128])
        size >>= 7
    return bytes([number << 3 | 2]) + digits + bytes([size]) + payload


def record(seed):
    """A framed record of a run whose places are drawn from a seed, and the places."""
    world = np.random.default_rng(seed).normal(size=(T, N, 3)).astype("f4")
    features = {"world_pos": world.tobytes(), "mesh_pos": world[:1].tobytes(), "node_type": np.zeros((1, N, 1), "i4").tobytes(), "stress": b"1234"}
    entries = b"".join(field(1, field(1, k.encode()) + field(2, field(1, field(1, v)))) for k, v in features.items())
    message = field(1, entries)
    return struct.pack("<Q", len(message)) + b"\0" * 4 + message + b"\0" * 4, world


@pytest.fixture
def landed(tmp_path):
    runs = [record(i) for i in range(13)]
    (tmp_path / "a.rec").write_bytes(b"".join(r for r, _ in runs[:9]))
    (tmp_path / "b.rec").write_bytes(b"")
    (tmp_path / "c.rec").write_bytes(b"".join(r for r, _ in runs[9:]))
    return str(tmp_path), runs


def test_ranges_cover_whole_records(spark, landed):
    path, runs = landed
    size = len(runs[0][0])
    got = sorted((r.first, r.start, r.records, r.path[-5:]) for r in tables.record_ranges(spark, path, 4 * size).collect())
    assert got == [(0, 0, 4, "a.rec"), (4, 4 * size, 4, "a.rec"), (8, 8 * size, 1, "a.rec"), (9, 0, 4, "c.rec")]


@pytest.mark.parametrize("piece", [1, 700, tables.PIECE])
def test_runs_are_the_same_however_files_are_split(spark, landed, piece):
    path, runs = landed
    df = tables.ingest_tensors(spark, path, META, piece=piece)
    got = {(r.sim, r.frame, r.node): (r.x, r.y, r.z) for r in df.collect()}
    assert len(got) == len(runs) * T * N
    assert all(got[i, f, k] == pytest.approx(tuple(w[f, k])) for i, (_, w) in enumerate(runs) for f in range(T) for k in range(N))


def test_one_file_is_many_tasks_work(spark, landed):
    from pyspark.sql import functions as F

    df = tables.ingest_tensors(spark, landed[0] + "/a.rec", META, piece=1)
    assert df.rdd.getNumPartitions() == 9 and df.select(F.spark_partition_id()).distinct().count() > 3


@pytest.mark.parametrize("limit", [0, 1, 5, 11, 50])
def test_limit_counts_over_all_files(spark, landed, limit):
    df = tables.ingest_tensors(spark, landed[0], META, limit=limit, piece=700)
    assert sorted(r.sim for r in df.select("sim").distinct().collect()) == list(range(min(limit, 13)))


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(record(0)[0][:-3])
    with pytest.raises(Exception, match="ends within a record"):
        tables.ingest_tensors(spark, str(tmp_path), META).count()
