"""Intermediate tables that several later steps read.

They are written to the shared folder of ``spark.checkpoint.dir`` (else the
session's warehouse) and read back: the lineage ends there, a lost executor
costs nothing, and the planner knows the real size of the table when it decides
whether to broadcast it.

All tables of a run lie in one folder. ``scratch_run`` opens a run for a block
of code and removes its folder at the end; outside such a block the run is that
of the application, and ``close_scratch`` removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "lexifold"
_RUN: ContextVar[str | None] = ContextVar("lexifold_run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor reaches."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{_FOLDER}/{_RUN.get() or spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def close_scratch(spark: SparkSession) -> None:
    """Remove all tables of the current run. What was read from them, results not yet written included, is gone."""
    remove_folder(spark, _run_folder(spark))


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """A run of its own: write the results inside the block, as its tables are removed at the end."""
    token = _RUN.set(f"run-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        close_scratch(spark)
        _RUN.reset(token)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a source with fewer splits than cores, spread for CPU-bound text work; larger sources stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def broadcast_if_small(df: DataFrame, n_rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast when the rows were counted, or bounded by a count, and are few; else leave the join to the planner."""
    return F.broadcast(df) if n_rows <= max_rows else df


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside the block remove the files of their shuffles when they end; else those stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a folder of its own and return the written table."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    return write_table(df, new_folder(df.sparkSession, name))
