"""Cutting long plans by reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_holding: ContextVar[bool] = ContextVar("holding", default=False)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a checkpoint in the folder all executors share (spark.checkpoint.dir): what builds
    on it is planned without df's own plan, and lost executors don't lose it. Where no folder is set, a local master gets a
    temporary one."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same by Parquet files, which take a fraction of a checkpoint's disk but don't tell how the rows were dealt or ordered."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def holding(spark: SparkSession) -> Iterator[None]:
    """For the jobs that run inside, `kept` holds tables on the tasks' own disks, where their rows lie; all are dropped at the end."""
    before, token = set(spark.sparkContext._jsc.getPersistentRDDs()), _holding.set(True)
    try:
        yield
    finally:
        _holding.reset(token)
        for number, rdd in dict(spark.sparkContext._jsc.getPersistentRDDs()).items():
            if number not in before:
                rdd.unpersist()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and planned without df's own plan: inside `holding` by a compressed local checkpoint, which moves no rows
    and knows how they are dealt (a lost executor ends the job), else as cut does."""
    return df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY) if _holding.get() else cut(df)


def _folder(df: DataFrame) -> str:
    """The folder of the checkpoints."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()
