"""Session helpers shared by the whole library."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Seconds between two collections of the driver's garbage, at least.
PAUSE = 3
_freed: dict[str, float] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = f"{ROOT}{os.pathsep}{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


#: Bytes of a batch of rows that goes to a Python worker, about: what a worker holds doesn't grow with its task's input.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Cut batches for Python workers at BATCH bytes, unless the session has a limit of its own."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, BATCH)


#: Bytecode of one method that HotSpot still compiles.
MOST_BYTECODE = "8000"


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside have no generated method that is too long for HotSpot, which would interpret it: a plan with one is
    evaluated by several short ones. A session's own limit stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    own = spark.conf.get(limit, None)
    if own is None:
        spark.conf.set(limit, MOST_BYTECODE)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(limit)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Unset, it is a new temporary folder, which only a local master may use.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/modq/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so once the driver's JVM has collected what refers to them, which else may be half an hour later
    (spark.cleaner.periodicGC.interval), with all intermediate shuffles of a long job on disk until then.
    """
    if time.monotonic() - _freed.get("at", -PAUSE) >= PAUSE:
        spark.sparkContext._jvm.System.gc()
        _freed["at"] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the plan is cut
    there, a lost executor costs no recomputation, and later readers prune columns."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if getattr(_open, "tables", None) is not None:
        _open.tables.append(out)
    return out


_open = threading.local()


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() makes inside, in this thread, are deleted at the end: what is derived from them must be written by then."""
    outer, _open.tables = getattr(_open, "tables", None), []
    try:
        yield
    finally:
        made, _open.tables = _open.tables, outer
        release(*made)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def delete(spark: SparkSession, path: str) -> None:
    fs, found = file_system(spark, path)
    fs.delete(found, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that written() made, once what was derived from them is written itself."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
