import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.operators import detect
from trajscreen.plans.fixtures import view
from trajscreen.streaming import monitor

SF = "/root/testdata/sf0.001"
SCHEMA = "sim bigint, frame int, node int, x double, y double, z double, ts timestamp"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Plate nodes of a few runs, one file for each stretch of frames."""
    path = str(tmp_path_factory.mktemp("stream"))
    p = view(spark, SF, "positions").where("node <= 4 and sim <= 3 and frame < 60").withColumn("ts", F.timestamp_seconds(F.col("frame")))
    for start in range(0, 60, 20):
        p.where((F.col("frame") >= start) & (F.col("frame") < start + 20)).coalesce(1).write.mode("append").parquet(path)
    return p, path


def drained(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_monitor_equals_batch(spark, landed):
    p, path = landed
    got = {(r.sim, r.frame, r.detector): r.score for r in drained(monitor.monitor(source(spark, path)), spark, "scores").where("not late").collect()}
    rest = view(spark, SF, "rest")
    for name, scores, first in (("constvel", detect.constvel_scores(p), 2), ("velocity_causal", detect.velocity_causal_scores(p), 5)):
        batch = {(r.sim, r.frame, name): r.score for r in detect.frame_scores(scores, rest).where(F.col("frame") >= first).collect()}
        assert {k for k in got if k[2] == name} == set(batch)
        assert all(abs(got[k] - v) < 1e-6 * max(1, abs(v)) for k, v in batch.items())


def test_split_frames_equal_batch(spark, landed, tmp_path):
    p = landed[0].where("frame < 30")
    for i in range(6):  # each file has the last three nodes of one frame, whole frames, and two nodes of the next
        lo, hi = 5 * i, 5 * i + 5
        part = p.where((F.col("frame") > lo) & (F.col("frame") < hi) | (F.col("frame") == lo) & ((F.col("node") >= 2) | F.lit(i == 0)) | (F.col("frame") == hi) & (F.col("node") < 2))
        part.coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    stream = source(spark, str(tmp_path / "*"))
    got = {(r.sim, r.frame, r.detector): r.score for r in drained(monitor.monitor(stream), spark, "split").collect()}
    rest = view(spark, SF, "rest")
    want = {}
    for name, scores, first in (("constvel", detect.constvel_scores(p), 2), ("velocity_causal", detect.velocity_causal_scores(p), 5)):
        want |= {(r.sim, r.frame, name): r.score for r in detect.frame_scores(scores, rest).where(F.col("frame") >= first).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - v) < 1e-6 * max(1, abs(v)) for k, v in want.items())


def test_late_frames_are_reported(spark, landed, tmp_path):
    p, _ = landed
    path = str(tmp_path)
    for i, frames in enumerate(("frame between 10 and 20", "frame between 5 and 9")):
        p.where(frames).coalesce(1).write.parquet(f"{path}/{i}")
        for f in os.listdir(f"{path}/{i}"):
            os.utime(f"{path}/{i}/{f}", (1_000_000 + i * 100, 1_000_000 + i * 100))  # files are read in the order of their times
    out = drained(monitor.monitor(source(spark, f"{path}/*")), spark, "late")
    assert out.where("late").count() == 5 * p.select("sim").distinct().count()
    assert out.where("not late and score is null").count() == 0


def test_alarms_come_once_for_good(spark, tmp_path):
    rows = [(1, f, "d", float(f % 7)) for f in range(40)]
    df = spark.createDataFrame(rows, "sim long, frame int, detector string, score double").withColumn("ts", F.timestamp_seconds(F.col("frame") * 3600))
    for i in range(4):  # an hour a frame: far beyond any watermark's delay
        df.where(F.col("frame") % 4 == i).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for f in os.listdir(f"{tmp_path}/{i}"):
            os.utime(f"{tmp_path}/{i}/{f}", (1_000_000 + i * 100, 1_000_000 + i * 100))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = drained(monitor.first_alarms(stream, spark.createDataFrame([("d", 4.5)], "detector string, threshold double")), spark, "once").collect()
    assert [r.frame for r in got] == [12]


def test_alarms_and_maxima(spark, landed):
    p, path = landed
    frames = source(spark, path).select("sim", "frame", "ts", F.lit("z").alias("detector"), F.col("z").alias("score"))
    thresholds = spark.createDataFrame([("z", 1.0)], "detector string, threshold double")
    alarms = drained(monitor.first_alarms(frames, thresholds), spark, "alarms").collect()
    assert sorted({r.sim for r in alarms}) == sorted({r.sim for r in p.where("z > 1").select("sim").distinct().collect()}) and len(alarms) == len({r.sim for r in alarms})
    maxima = drained(monitor.running_maxima(frames), spark, "maxima", "complete")
    assert {(r.sim, r.run_max) for r in maxima.collect()} == {(r.sim, r.m) for r in p.groupBy("sim").agg(F.max("z").alias("m")).collect()}


def test_median_and_spread_in_place():
    rng = np.random.default_rng(3)
    for m in range(1, 40):
        rows = np.sort(np.round(rng.normal(size=(30, m)), 1), axis=1)  # with ties
        centre, spread = monitor.middle_and_spread(rows)
        assert np.allclose(centre, np.median(rows, axis=1)) and np.allclose(spread, np.median(np.abs(rows - centre[:, None]), axis=1))


def test_calibrated_scores_equal_batch(spark, landed):
    p, path = landed
    calib, rest = range(5, 1000, 10), view(spark, SF, "rest")
    later = source(spark, path).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 100))  # a watermark begins at 0 and drops what is as old
    stream = monitor.monitor(later, calib=calib, delay="1 second")
    got = {(r.sim, r.frame, r.detector): r.score for r in drained(stream, spark, "calibrated").where("not late").collect()}
    own = rest.where("node <= 4")  # the stream has these nodes of the plate
    for name, raw in (("constvel", detect.constvel_scores(p)), ("velocity_causal", detect.velocity_causal_scores(p))):
        batch = detect.frame_scores(detect.calibrated_causal(raw, own, calib), own).where("frame >= 29").collect()
        want = {(r.sim, r.frame, f"{name}_calibrated"): r.score for r in batch}
        assert want and {key for key in got if key[2] == f"{name}_calibrated"} == set(want)
        assert all(got[key] == pytest.approx(v, rel=1e-6) for key, v in want.items())


def test_runs_end_by_event_time(spark, landed, tmp_path):
    """The last frame lacks a node: it waits till the watermark has passed, then the run's state is gone."""
    p = landed[0].where("sim = 1 and frame between 1 and 11 and not (frame = 11 and node = 0)")
    other = landed[0].where("sim = 2 and frame < 3").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000))
    back = landed[0].where("sim = 1 and frame = 9")  # behind the first batch's watermark: Spark drops it
    for i, part in enumerate((p, other, back)):
        part.coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for f in os.listdir(f"{tmp_path}/{i}"):
            os.utime(f"{tmp_path}/{i}/{f}", (1_000_000 + i * 100, 1_000_000 + i * 100))
    stream = monitor.monitor(source(spark, f"{tmp_path}/*"), delay="1 second", idle_ms=5000)
    q = stream.writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("ended").collect()
    assert max(r.frame for r in got if r.sim == 1) == 10 and not [r for r in got if r.late]
    held = [(s["numRowsTotal"], s["numRowsDroppedByWatermark"]) for e in q.recentProgress for s in e["stateOperators"]]
    assert max(n for n, _ in held) == 2 and held[-1] == (1, 5)
