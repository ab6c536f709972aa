"""Audit log of answered and refused questions."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.sources.scratch import materialize


def read_audit_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows, or None where nothing was ever logged."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_audit_log(
    answers: DataFrame, path: str, logged_at: datetime.datetime | None = None, batch_id: str | None = None
) -> None:
    """``answers`` from ``answer_questions``. Input errors and generator failures are not logged.

    With a ``batch_id``, a question of the batch is logged once, however often the job is repeated and wherever an
    earlier attempt stopped: what the log has of the batch is left out. Repeats should hand over the same answers.
    """
    spark = answers.sparkSession
    stamp = F.lit(logged_at).cast("timestamp") if logged_at else F.current_timestamp()
    rows = answers.where(F.col("status") == 200)
    if batch_id is not None:
        log = read_audit_log(spark, path)
        if log is not None and "batch_id" in log.columns:
            logged = log.where(F.col("batch_id") == batch_id).select("query_id")
            rows = rows.join(materialize(logged, "logged"), "query_id", "left_anti")
    rows.select(
        "question",
        "answerable",
        "refusal_reason",
        "model",
        "latency_ms",
        "response_json",
        stamp.alias("created_at"),
        F.lit(batch_id).cast("string").alias("batch_id"),
        "query_id",
        F.to_date(stamp).alias("created_on"),
    ).write.mode("append").partitionBy("created_on").parquet(path)


def compact_audit_log(spark: SparkSession, path: str, day: datetime.date, files: int = 1) -> None:
    """The rows of one day in ``files`` files; other days are not touched. Run it when nobody appends to that day."""
    log = read_audit_log(spark, path)
    if log is None:
        return
    rows = materialize(log.where(F.col("created_on") == F.lit(day)), "log-day")
    rows.coalesce(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_on").parquet(path)
