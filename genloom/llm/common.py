"""Helpers that several operators share: scratch tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths written inside a stage of the pipeline; the next stage deletes them, as its input has been written by then. Each
#: thread has its own.
_stage_paths: ContextVar[list[str] | None] = ContextVar("stage_paths", default=None)
_recording: ContextVar[bool] = ContextVar("recording", default=False)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a local one if the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="genloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_folder(spark)}/genloom/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if _recording.get():
        _stage_paths.get().append(path)
    return path


def materialize(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors. `group_bytes`: about
    how large row groups get, for rows of megabytes; Parquet looks at their size every 100 rows only, and a row group is held whole
    to be written and read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    checks = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**checks if group_bytes else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_scratch(spark: SparkSession):
    """Scratch tables made inside belong to a pipeline stage; those of the stage before are deleted first."""
    for path in _stage_paths.get() or ():
        p, fs = _hadoop_path(spark, path)
        fs.delete(p, True)
    _stage_paths.set([])
    _recording.set(True)
    try:
        yield
    finally:
        _recording.set(False)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast `df` only if its counted `rows` are at most `most`; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z lower-cased, all else untouched; texts of ASCII only take the fast path."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, up, low))


def ship_by_value(module: str) -> None:
    """Send this module's functions to Python workers whole, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
