"""Document store: versions of two tables, made of segments that are bucketed by ``source_id``.

A version is a list of segments. ``write_store`` writes one segment with everything, ``write_changes`` one with the
documents that differ from the version they were compared with, and the ids it replaces or removes; all other
segments are read as they are, so what is written follows the change. Documents, chunks and replaced ids of all
segments are bucketed alike: neither dropping former versions of a document nor joining documents with their chunks
moves a row of the store.

A version becomes visible when its row is appended to ``commits``, after its segment is complete, so readers never
see a half-written store. The row names all segments, and the folder of a segment is one of its own for every write:
of two writers that start from the same version neither touches the other's files, and all readers agree on which of
the two counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.sources.bucketed import read_bucketed, write_bucketed

DOCUMENTS_PER_BUCKET = 100_000
# A version of more segments than this is written as one segment again.
MAX_SEGMENTS = 16
DOCUMENT_SCHEMA = (
    "source_id string, file_name string, document_key string, title string, version string, effective_date date, "
    "status string, category string, supersedes string, content_hash string, created_at timestamp, updated_at timestamp"
)
CHUNK_SCHEMA = (
    "source_id string, chunk_order int, section_path string, content string, "
    "embedding array<float>, embedding_model string"
)


REPLACED_SCHEMA = "source_id string"
COMMIT_SCHEMA = "store_version long, folder string, buckets int, segments array<string>"


@dataclass(frozen=True)
class Version:
    """What a store was read from; number 0 is that of a store without a commit."""

    number: int = 0
    segments: tuple[str, ...] = ()
    buckets: int = 0


@dataclass(frozen=True)
class Store:
    documents: DataFrame
    chunks: DataFrame
    version: Version = Version()


@dataclass(frozen=True)
class StoreChanges:
    """Documents that differ from the version ``base``, with all their chunks, and the ids they replace or remove.

    ``replaced`` holds every id that is added, updated or removed, as the store spells it.
    """

    base: Version
    documents: DataFrame
    chunks: DataFrame
    replaced: DataFrame


class StoreMoved(RuntimeError):
    """Another version was committed since the changes were computed; compute them again from the store as it is now."""


def empty_store(spark: SparkSession) -> Store:
    return Store(spark.createDataFrame([], DOCUMENT_SCHEMA), spark.createDataFrame([], CHUNK_SCHEMA))


def _committed(spark: SparkSession, path: str) -> Version:
    """The last version; of equal numbers the later folder name counts."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version()
    last = commits.agg(F.max(F.struct("store_version", "folder", "buckets", "segments")).alias("last")).first()["last"]
    return Version(last["store_version"], tuple(last["segments"]), last["buckets"]) if last else Version()


def segment_table(spark: SparkSession, schema: str, path: str, buckets: int) -> DataFrame:
    """One table of a segment. The files name the id ``id``: renamed by a projection, it is the same attribute, nullability
    included, in the partitioning of all segments, and only then does a union of bucketed tables count as bucketed in a join.
    """
    table = read_bucketed(spark, schema.replace("source_id", "id", 1), path, buckets, "id")
    return table.withColumnRenamed("id", "source_id")


def read_store(spark: SparkSession, path: str) -> Store:
    version = _committed(spark, path)
    if not version.segments:
        return empty_store(spark)

    def of_all(schema: str, name: str, first: int = 0) -> DataFrame:
        read = [
            segment_table(spark, schema, f"{path}/{folder}/{name}", version.buckets).withColumn("segment", F.lit(number))
            for number, folder in enumerate(version.segments)
            if number >= first
        ]
        return reduce(DataFrame.unionByName, read)

    def live(schema: str, name: str) -> DataFrame:
        rows = of_all(schema, name)
        if len(version.segments) > 1:
            later = of_all(REPLACED_SCHEMA, "replaced", 1).select(F.col("source_id").alias("gone_id"), F.col("segment").alias("gone_by"))
            rows = rows.join(later, (F.col("source_id") == F.col("gone_id")) & (F.col("segment") < F.col("gone_by")), "left_anti")
        return rows.drop("segment")

    return Store(live(DOCUMENT_SCHEMA, "documents"), live(CHUNK_SCHEMA, "chunks"), version)


def _write_segment(documents: DataFrame, chunks: DataFrame, replaced: DataFrame, path: str, number: int, buckets: int) -> str:
    """The folder of a new segment, each table sorted within its buckets so that a lookup skips pages."""
    folder = f"version-{number}-{uuid.uuid4().hex[:12]}"
    tables = (("documents", documents, ("id",)), ("chunks", chunks, ("id", "chunk_order")), ("replaced", replaced, ("id",)))
    for name, rows, order in tables:
        placed = rows.withColumnRenamed("source_id", "id").repartition(buckets, "id").sortWithinPartitions(*order)
        write_bucketed(placed, f"{path}/{folder}/{name}", buckets, "id")
    return folder


def _commit(spark: SparkSession, path: str, number: int, segments: tuple[str, ...], buckets: int) -> Store:
    commit = spark.range(number, number + 1).select(
        F.col("id").alias("store_version"), F.lit(segments[-1]).alias("folder"), F.lit(buckets).alias("buckets"),
        F.array(*[F.lit(s) for s in segments]).alias("segments"),
    )
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return read_store(spark, path)


def write_store(store: Store, path: str, buckets: int | None = None) -> Store:
    """Write everything as the next version and commit it. The version being read is never touched.

    ``buckets`` grows with the documents by default, so that a bucket stays the work of one task.
    """
    spark = store.documents.sparkSession
    number = _committed(spark, path).number + 1
    buckets = buckets or max(spark.sparkContext.defaultParallelism, -(-store.documents.count() // DOCUMENTS_PER_BUCKET))
    nothing = spark.createDataFrame([], REPLACED_SCHEMA)
    folder = _write_segment(store.documents, store.chunks, nothing, path, number, buckets)
    return _commit(spark, path, number, (folder,), buckets)


def write_changes(changes: StoreChanges, path: str) -> Store:
    """Write the changed documents as a segment of the next version and commit it; refused if the store has moved on.

    A store without a commit gets its first version; one of ``MAX_SEGMENTS`` segments is written as one segment again.
    """
    spark = changes.documents.sparkSession
    if _committed(spark, path) != changes.base:
        raise StoreMoved(path)
    if not changes.base.segments:
        return write_store(Store(changes.documents, changes.chunks), path)
    number, buckets = changes.base.number + 1, changes.base.buckets
    folder = _write_segment(changes.documents, changes.chunks, changes.replaced, path, number, buckets)
    if _committed(spark, path) != changes.base:  # the segment took its time
        raise StoreMoved(path)
    written = _commit(spark, path, number, (*changes.base.segments, folder), buckets)
    return write_store(written, path) if len(written.version.segments) > MAX_SEGMENTS else written


def documents_with_chunks(store: Store) -> DataFrame:
    """Every document with its chunks; a document without chunks keeps one row with nulls."""
    return store.documents.join(store.chunks, "source_id", "left").orderBy("source_id", "chunk_order")
