"""Reads of the store and the index: list, detail, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.functions.text import unicode_trim
from lexifold.plans.index import LEXICAL, KnowledgeIndex
from lexifold.sources.scratch import materialize
from lexifold.sources.store import Store

SUMMARY_FIELDS = ("source_id", "document_key", "title", "version", "effective_date", "status", "category", "supersedes")


def list_documents(store: Store) -> DataFrame:
    """Every document with its number of sections, by id."""
    counts = store.chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("section_count"))
    return (
        store.documents.select(*SUMMARY_FIELDS)
        .join(counts, "source_id", "left")
        .withColumn("section_count", F.coalesce("section_count", F.lit(0)))
        .orderBy("source_id")
    )


def look_up(store: Store, ids: DataFrame) -> DataFrame:
    """``requested_id`` -> the document of exactly that id (trimmed) with status 200, or 404."""
    wanted = ids.select("requested_id", unicode_trim(F.col("requested_id")).alias("source_id"))
    return wanted.join(store.documents.select(*SUMMARY_FIELDS), "source_id", "left").withColumn(
        "http_status", F.when(F.col("document_key").isNull(), 404).otherwise(200)
    )


def document_detail(store: Store, ids: DataFrame) -> DataFrame:
    """One row per section of each document found; a document without sections keeps one row."""
    found = look_up(store, ids)
    sections = store.chunks.select("source_id", "chunk_order", "section_path", "content")
    return found.join(sections, "source_id", "left").orderBy("source_id", "chunk_order")


def document_versions(versions: DataFrame) -> DataFrame:
    """Every version of every family, oldest effective date first, with the size of its family.

    One huge family is no single task: its rows are sorted by the whole key, and
    against the written sizes a skewed join can be split.
    """
    sizes = materialize(versions.groupBy("document_key").agg(F.count(F.lit(1)).alias("n_versions")), "family-sizes")
    return versions.join(sizes, "document_key").orderBy("document_key", "effective_date", "file_name")


def status(index: KnowledgeIndex | None, spark, generator: str | None = None, embedder: str | None = None) -> DataFrame:
    """One row: ``ok`` when there is an index and a generator is configured, else ``degraded``."""
    ready = index is not None
    nothing = "cast(0 as bigint) as n_documents", "cast(0 as bigint) as n_chunks", f"'{LEXICAL}' as mode"
    known = index.summary if ready else spark.range(1).selectExpr(*nothing)
    return known.select(
        F.lit("ok" if ready and generator else "degraded").alias("status"),
        F.lit(ready).alias("ready"),
        F.col("n_documents").alias("documents"),
        F.col("n_chunks").alias("sections"),
        F.col("mode").alias("retrieval_mode"),
        F.lit(generator is not None).alias("generator_configured"),
        F.lit(embedder is not None).alias("embedder_configured"),
    )
