"""Source files against stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_FIELDS = ("document_key", "title", "version", "effective_date", "status", "category", "supersedes", "content_hash")


def duplicate_ids(sources: DataFrame) -> DataFrame:
    """Ids that several files use, whatever the case; spelled as in the first file by name."""
    return (
        sources.groupBy(F.upper("source_id").alias("id_key"))
        .agg(F.count(F.lit(1)).alias("files"), F.min_by("source_id", "file_name").alias("source_id"))
        .where(F.col("files") > 1)
        .select("source_id", "files")
    )


def reconcile(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per document of either side with its ``action``.

    Added and updated documents take the source's metadata, unchanged ones the
    stored metadata. The stored spelling of an id survives. Bodies are not
    needed here and should not be passed in.
    """
    left = sources.select(
        F.upper("source_id").alias("id_key"),
        F.struct("source_id", "file_name", *DOCUMENT_FIELDS).alias("new"),
    )
    right = stored.select(
        F.upper("source_id").alias("id_key"),
        F.struct("source_id", "file_name", *DOCUMENT_FIELDS, "created_at", "updated_at").alias("old"),
    )
    action = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.content_hash") == F.col("new.content_hash"), "unchanged")
        .otherwise("updated")
    )
    joined = left.join(right, "id_key", "full").withColumn("action", action)
    from_source = F.col("action").isin("added", "updated")
    return joined.select(
        "action",
        F.coalesce("old.source_id", "new.source_id").alias("source_id"),
        F.coalesce("new.file_name", "old.file_name").alias("file_name"),
        *[F.when(from_source, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in DOCUMENT_FIELDS],
        F.col("old.created_at").alias("created_at"),
        F.col("old.updated_at").alias("updated_at"),
    )


def embedding_pending(model: str) -> Column:
    """A chunk without a vector, or with another model's vector."""
    return F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))


def action_counts(plan: DataFrame) -> DataFrame:
    def count(name: str):
        return F.count_if(F.col("action") == name).alias(name)

    return plan.agg(
        F.count_if(F.col("action") != "removed").alias("documents"),
        count("added"), count("updated"), count("removed"), count("unchanged"),
    )
