"""Tables bucketed by a key: joins and aggregates by that key read them without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lexifold.sources.scratch import shuffles_removed


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "doc_no") -> None:
    write_bucketed_parts([df], path, buckets, key)


def write_bucketed_parts(parts: Sequence[DataFrame], path: str, buckets: int, key: str = "doc_no") -> None:
    """One table of several parts, written one after the other; a bucket has a file of each."""
    # The catalogue entry only carries the bucketing; the data stays at the path.
    name = f"lexifold_write_{uuid.uuid4().hex[:12]}"
    for number, df in enumerate(parts):
        with shuffles_removed(df.sparkSession):
            writer = df.write.mode("append") if number else df.write
            writer.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    parts[0].sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, columns: str, path: str, buckets: int, key: str = "doc_no") -> DataFrame:
    name = f"lexifold_{uuid.uuid4().hex[:12]}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    table = spark.table(name)
    # The table is resolved by now; the catalogue entry of this external table only carried the bucketing.
    spark.sql(f"DROP TABLE {name}")
    return table
