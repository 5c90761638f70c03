"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder of this session: the cluster's own, or a new local one where none is set and all runs on one
    machine, as in tests."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows and BATCH_BYTES bytes at most, or one row: texts may be long, and a batch is
    in memory whole on both sides. The session keeps the setting, as plans read it when they run."""
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def _number(size: str) -> int:
    """Bytes of a Spark size such as 64MB; other units are left to Spark."""
    for unit, shift in (("kb", 10), ("mb", 20), ("gb", 30), ("k", 10), ("m", 20), ("g", 30), ("b", 0)):
        if size.lower().endswith(unit):
            return int(size[: -len(unit)]) << shift
    return int(size)


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(step: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``step`` for mapInArrow; at its end the worker gives free memory back, as it is reused and others wait beside it."""

    @wraps(step)
    def run(*args, **named):
        try:
            yield from step(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return run


def path(spark: SparkSession, name: str) -> str:
    """A path that no other call returns."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet: later work doesn't recompute them, and lost executors don't lose them."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def save_once(df: DataFrame, name: str) -> DataFrame:
    """``save``, for rows that are computed this once: their shuffle files go when they are written, not when the driver's
    garbage collector comes to it."""
    spark = df.sparkSession
    was = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        return save(df, name)
    finally:
        if was is None:
            spark.conf.unset(_FREES)
        else:
            spark.conf.set(_FREES, was)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
