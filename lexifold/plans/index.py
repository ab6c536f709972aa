"""Index tables: built once per store version, read by every search.

``chunks`` and ``postings`` are bucketed by document number, so the scores of a
document's chunks are summed where its postings lie. Document numbers follow
file-name order and settle every tie; between two of them there is room for the
documents of later segments.

An index is a list of *segments*: folders with the same tables, each written once.
``build_index`` writes one, ``update_index`` (``lexifold.plans.segments``) another
with the changed documents alone and the numbers that are dead from then on.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators.bm25 import block_maxima, document_frequencies, term_frequencies
from lexifold.options import DEFAULTS, RetrievalOptions
from lexifold.sources.bucketed import read_bucketed, write_bucketed, write_bucketed_parts
from lexifold.sources.scratch import materialize, new_folder, write_table
from lexifold.sources.store import Store

HYBRID, LEXICAL = "hybrid", "lexical"
# Numbers of neighbours in a new index are 2^24 apart; a block takes about 64 documents of a bucket.
GAP_BITS, BLOCK_BITS = 24, 6
# A task sorts the postings of a bucket and holds a score for each of its chunks and some hundred queries: in memory
# up to this many documents, and by spilling several times the input beyond.
DOCUMENTS_PER_BUCKET = 2_048
# Texts of so many documents are on the way at a time when a segment is written; the store is read once for each such wave.
DOCUMENTS_PER_WAVE = 1 << 17

VERSION_SCHEMA = (
    "doc_no bigint, source_id string, file_name string, document_key string, title string, version string, "
    "effective_date date, status string, category string"
)
CHUNK_COLUMNS = (
    "doc_no bigint, chunk_order int, source_id string, document_key string, title string, version string, "
    "effective_date date, status string, category string, section_path string, content string, "
    "embedding array<float>, embedding_model string"
)
POSTING_COLUMNS = "doc_no bigint, chunk_order int, dl int, term string, tf bigint"
TERM_COLUMNS = "term string, df bigint"
BLOCK_COLUMNS = "term string, block bigint, max_tf bigint, min_dl int"
DEAD_COLUMNS = "doc_no bigint"
SUMMARY_COLUMNS = (
    "n_documents bigint, n_chunks bigint, n_terms bigint, mode string, embedding_model string, buckets int, built_at timestamp, "
    "n_usable bigint, n_dead bigint, segments array<string>"
)


@dataclass(frozen=True)
class KnowledgeIndex:
    """The live rows of all segments, and the counts over them. ``blocks`` may have bounds of dead documents too."""

    chunks: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    versions: DataFrame
    n_documents: int
    n_chunks: int
    n_terms: int
    mode: str
    embedding_model: str | None
    built_at: datetime.datetime
    path: str
    buckets: int
    n_usable: int
    n_dead: int
    segments: tuple[str, ...]

    @property
    def average_length(self) -> float:
        """At least 1, also for an empty corpus."""
        return max(1.0, self.n_terms / self.n_chunks) if self.n_chunks else 1.0

    @property
    def summary(self) -> DataFrame:
        """One row: the counts and the mode, as written with the index."""
        return self.chunks.sparkSession.read.schema(SUMMARY_COLUMNS).parquet(f"{self.path}/summary")

    @property
    def vectors(self) -> DataFrame:
        return self.chunks.select("doc_no", "chunk_order", "embedding")

    def near(self, rows: DataFrame, n_rows: int, options: RetrievalOptions = DEFAULTS) -> KnowledgeIndex:
        """The index as seen by lookups of the documents in ``rows`` (``doc_no``; at most ``n_rows``).

        Few documents are named in the filter, and the buckets of all others are skipped.
        """
        if n_rows > options.max_pruned_documents:
            return self
        numbers = [row[0] for row in rows.select("doc_no").distinct().collect()]
        wanted = F.col("doc_no").isin(numbers) if numbers else F.lit(False)
        return replace(self, chunks=self.chunks.where(wanted), postings=self.postings.where(wanted))


def number_documents(documents: DataFrame) -> DataFrame:
    """Number documents by file name, ``2 ** GAP_BITS`` apart."""
    columns = VERSION_SCHEMA.replace(",", "").split()[2::2]
    ordered = documents.select(*columns).orderBy("file_name")
    ordered = materialize(ordered.select(F.monotonically_increasing_id().alias("place"), *columns), "documents-in-order")
    part = F.shiftrightunsigned("place", 33).cast("int")
    counts = {row["part"]: row["count"] for row in ordered.groupBy(part.alias("part")).count().collect()}  # a row for each task
    before, total = [], 0
    for number in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(number, 0)
    start = F.get(F.array(*[F.lit(n).cast("long") for n in before or [0]]), part)
    number = start + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ordered.select(F.shiftleft(number, GAP_BITS).alias("doc_no"), *columns)


def block_of(doc_no: Column, buckets: int, segment: int, segments: int = 1 << 10) -> Column:
    """The block of a document: neighbours in file-name order that lie in one bucket of one segment."""
    stretch = F.shiftright(doc_no, GAP_BITS + BLOCK_BITS + (buckets - 1).bit_length())
    return (stretch * buckets + F.pmod(F.hash(doc_no), F.lit(buckets))) * segments + segment


def vectors_usable(chunks: DataFrame, model: str | None) -> DataFrame:
    """One row: hybrid when there is a chunk and every chunk has a vector of this very model."""
    usable = F.coalesce(
        F.bool_and(F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model))), F.lit(False)
    )
    mode = F.when(usable & F.lit(model is not None), HYBRID).otherwise(LEXICAL)
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), mode.alias("mode"))


def bucket_count(n_documents: int, parallelism: int) -> int:
    return max(parallelism, -(-n_documents // DOCUMENTS_PER_BUCKET))


def build_index(store: Store, model: str | None = None, path: str | None = None, buckets: int | None = None) -> KnowledgeIndex:
    """Write the index tables of a store. ``model`` is the embedder's name, None without an embedder.

    ``buckets`` fixes the parallelism of searches; by default it grows with the
    documents, so that a bucket stays the work of one task.
    """
    spark = store.documents.sparkSession
    path = path or new_folder(spark, "index")

    n_documents = store.documents.count()
    buckets = buckets or bucket_count(n_documents, spark.sparkContext.defaultParallelism)
    written = write_segment(store, number_documents(store.documents), path, buckets)
    counts = segment_counts(spark, written.chunks, written.postings, model)
    write_summary(spark, path, n_documents, counts, model, buckets, 0, (path,))
    return load_index(spark, path)


@dataclass(frozen=True)
class Segment:
    chunks: DataFrame
    postings: DataFrame


def write_segment(store: Store, versions: DataFrame, path: str, buckets: int, segment: int = 0) -> Segment:
    """The tables of the documents in ``versions`` (numbered) under ``path``: versions, chunks, postings, blocks, terms."""
    spark = versions.sparkSession
    versions.write.parquet(f"{path}/versions")
    versions = spark.read.schema(VERSION_SCHEMA).parquet(f"{path}/versions")

    chunk_names = CHUNK_COLUMNS.replace(",", "").split()[0::2]
    # The texts are shuffled for the documents of a wave only, whose files go before the next.
    waves = max(1, -(-versions.count() // DOCUMENTS_PER_WAVE))
    parts = []
    for wave in range(waves):
        of_wave = F.pmod(F.xxhash64("source_id"), F.lit(waves)) == wave if waves > 1 else F.lit(True)
        part = store.chunks.where(of_wave).join(versions.where(of_wave), "source_id").select(*chunk_names).repartition(buckets, "doc_no")
        parts.append(part.sortWithinPartitions("doc_no", "chunk_order"))
    write_bucketed_parts(parts, f"{path}/chunks", buckets)
    chunks = read_bucketed(spark, CHUNK_COLUMNS, f"{path}/chunks", buckets)

    # Bucketed scan, so neither the count per term nor the bucketed write moves a row. Sorted by term for row-group skipping.
    postings = term_frequencies(chunks).select("doc_no", "chunk_order", "dl", "term", "tf")
    write_bucketed(postings.sortWithinPartitions("term"), f"{path}/postings", buckets)
    postings = read_bucketed(spark, POSTING_COLUMNS, f"{path}/postings", buckets)

    # A block lies in one bucket, so what a task passes on is a row for each of its terms and blocks.
    maxima = block_maxima(postings.withColumn("block", block_of(F.col("doc_no"), buckets, segment)))
    write_table(maxima.sortWithinPartitions("term"), f"{path}/blocks")
    write_table(document_frequencies(postings).orderBy("term"), f"{path}/terms")
    return Segment(chunks, postings)


@dataclass(frozen=True)
class Counts:
    n_chunks: int
    n_usable: int
    n_terms: int


def segment_counts(spark: SparkSession, chunks: DataFrame, postings: DataFrame, model: str | None) -> Counts:
    """Chunks, chunks with a vector of this very model, and terms."""
    usable = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model)) & F.lit(model is not None)
    seen = chunks.agg(F.count(F.lit(1)), F.count_if(usable)).first()
    return Counts(seen[0], seen[1], postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])


def write_summary(
    spark: SparkSession, path: str, n_documents: int, counts: Counts, model: str | None, buckets: int, n_dead: int, segments: tuple[str, ...]
) -> None:
    """One row, written last: an index without it cannot be opened."""
    hybrid = model is not None and counts.n_chunks > 0 and counts.n_usable == counts.n_chunks
    spark.range(1).select(
        F.lit(n_documents).cast("bigint").alias("n_documents"),
        F.lit(counts.n_chunks).cast("bigint").alias("n_chunks"),
        F.lit(counts.n_terms).cast("bigint").alias("n_terms"),
        F.lit(HYBRID if hybrid else LEXICAL).alias("mode"),
        F.lit(model).cast("string").alias("embedding_model"),
        F.lit(buckets).alias("buckets"),
        F.current_timestamp().alias("built_at"),
        F.lit(counts.n_usable).cast("bigint").alias("n_usable"),
        F.lit(n_dead).cast("bigint").alias("n_dead"),
        F.array(*[F.lit(s) for s in segments]).alias("segments"),
    ).coalesce(1).write.parquet(f"{path}/summary")


def load_index(spark: SparkSession, path: str, options: RetrievalOptions = DEFAULTS) -> KnowledgeIndex:
    """Open written index tables; ``summary`` is written last, so a half-built index cannot be opened.

    Segments are bucketed alike, so their union keeps the bucketing; dead documents are told by their numbers, which
    are broadcast if few and otherwise lie in buckets of the same kind.
    """
    summary = spark.read.schema(SUMMARY_COLUMNS).parquet(f"{path}/summary").first()
    buckets, segments, n_dead = summary["buckets"], tuple(summary["segments"]), summary["n_dead"]

    def of_all(read: Callable[[int, str], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [read(number, folder) for number, folder in enumerate(segments)])

    dead = of_all(lambda n, folder: read_bucketed(spark, DEAD_COLUMNS, f"{folder}/dead", buckets) if n else spark.createDataFrame([], DEAD_COLUMNS))

    def live(rows: DataFrame) -> DataFrame:
        if not n_dead:
            return rows
        return rows.join(F.broadcast(dead) if n_dead <= options.max_broadcast_rows else dead, "doc_no", "left_anti")

    def postings(number: int, folder: str) -> DataFrame:
        table = read_bucketed(spark, POSTING_COLUMNS, f"{folder}/postings", buckets)
        return table.withColumn("block", block_of(F.col("doc_no"), buckets, number))

    terms = of_all(lambda _, folder: spark.read.schema(TERM_COLUMNS).parquet(f"{folder}/terms"))
    if len(segments) > 1:  # later segments take back what their dead documents had
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return KnowledgeIndex(
        chunks=live(of_all(lambda _, folder: read_bucketed(spark, CHUNK_COLUMNS, f"{folder}/chunks", buckets))),
        postings=live(of_all(postings)),
        blocks=of_all(lambda _, folder: spark.read.schema(BLOCK_COLUMNS).parquet(f"{folder}/blocks")),
        terms=terms,
        versions=live(of_all(lambda _, folder: spark.read.schema(VERSION_SCHEMA).parquet(f"{folder}/versions"))),
        n_documents=summary["n_documents"],
        n_chunks=summary["n_chunks"],
        n_terms=summary["n_terms"],
        mode=summary["mode"],
        embedding_model=summary["embedding_model"],
        built_at=summary["built_at"],
        path=path,
        buckets=buckets,
        n_usable=summary["n_usable"],
        n_dead=n_dead,
        segments=segments,
    )
