"""Bring a document store in line with a folder of markdown files."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions.text import embedding_text
from lexifold.operators.chunking import chunk_documents
from lexifold.operators.models import EmbedFn, embed_texts
from lexifold.operators.reconcile import action_counts, duplicate_ids, embedding_pending, reconcile
from lexifold.options import MAX_CHUNK_CHARS, EmbeddingOptions
from lexifold.plans.index import vectors_usable
from lexifold.sources.markdown import parse_markdown
from lexifold.sources.scratch import materialize, new_folder, remove_folder, write_table
from lexifold.sources.store import CHUNK_SCHEMA, DOCUMENT_SCHEMA, Store, StoreChanges

EMBEDDING_UNAVAILABLE = "embedding_unavailable"


class IngestRejected(ValueError):
    """The source is not acceptable; nothing is changed.

    ``code`` says why, ``detail`` names the first culprit; ``rows`` has all of them where there can be many.
    """

    def __init__(self, code: str, detail: str = "", rows: DataFrame | None = None) -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail, self.rows = code, detail, rows


@dataclass(frozen=True)
class IngestOutcome:
    """The next state of the store (not yet written), what differs from the former one, and a one-row summary."""

    store: Store
    plan: DataFrame
    summary: DataFrame
    changes: StoreChanges
    reused_vectors: int = 0


def check_sources(catalog: DataFrame) -> None:
    """All or nothing: one malformed file, a repeated id or an empty folder rejects the batch."""
    first = catalog.where(F.col("error").isNotNull()).agg(F.min(F.struct("file_name", "error")).alias("worst")).first()["worst"]
    if first is not None:
        raise IngestRejected(first["error"], first["file_name"])
    if catalog.isEmpty():
        raise IngestRejected("knowledge_base_empty")
    repeated = duplicate_ids(catalog)
    count, first = repeated.agg(F.count(F.lit(1)), F.min("source_id")).first()
    if count:
        raise IngestRejected("duplicate_document_id", first if count == 1 else f"{first} and {count - 1} more", repeated)


def next_documents(plan: DataFrame, run_at: datetime.datetime | None) -> DataFrame:
    stamp = F.lit(run_at).cast("timestamp") if run_at else F.current_timestamp()
    columns = [c for c in DOCUMENT_SCHEMA.replace(",", "").split()[0::2]]
    return (
        plan.where(F.col("action") != "removed")
        .withColumn("created_at", F.coalesce("created_at", stamp))
        .withColumn("updated_at", F.when(F.col("action") == "updated", stamp).otherwise(F.col("updated_at")))
        .select(*columns)
    )


def ingest(
    files: DataFrame,
    store: Store,
    embed: EmbedFn | None = None,
    embedding: EmbeddingOptions | None = None,
    run_at: datetime.datetime | None = None,
    max_chars: int = MAX_CHUNK_CHARS,
) -> IngestOutcome:
    """``files``: ``file_name, text``. Unchanged files keep chunks and vectors; the rest is chunked and embedded anew.

    The first pass over the texts keeps only metadata and hashes. Texts are
    read again, and chunked, for added and updated files alone. Of the stored
    chunks those of unchanged documents are neither moved nor written, but for
    documents that have a chunk without a vector of this model. A chunk of an
    updated file keeps the vector of a former chunk whose embedding text and
    model are the same; ``embedded_chunks`` counts these too, and
    ``reused_vectors`` says how many texts were not sent.
    """
    parsed = parse_markdown(files)
    catalog = materialize(parsed.drop("body"), "catalog")
    check_sources(catalog)
    plan = materialize(reconcile(catalog, store.documents), "plan")

    changed = plan.where(F.col("action").isin("added", "updated")).select("file_name", F.col("source_id").alias("stored_id"))
    bodies = parsed.select("file_name", "title", "body").join(changed, "file_name").select(
        F.col("stored_id").alias("source_id"), "title", "body"
    )
    columns = CHUNK_SCHEMA.replace(",", "").split()[0::2]
    fresh = chunk_documents(bodies, max_chars, ("title",)).select(
        "source_id", "chunk_order", "section_path", "content",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"), "title",
    )
    differing = plan.where(F.col("action") != "unchanged").select("source_id")
    kept = store.chunks.select(*columns).join(differing, "source_id", "left_anti")
    documents = materialize(next_documents(plan, run_at), "documents")

    embedded, reused, warning, model = 0, 0, None, None
    if embed is not None:
        embedding = embedding or EmbeddingOptions(model="default")
        model = embedding.model
        stale = materialize(kept.where(embedding_pending(model)).select("source_id").distinct(), "stale")
        differing = materialize(differing.unionByName(stale), "differing")
        updated = plan.where(F.col("action") == "updated").select("source_id")
        former = Store(*(rows.join(updated, "source_id", "left_semi") for rows in (store.documents, store.chunks)))
        folder = new_folder(store.documents.sparkSession, "known-vectors")
        known = write_table(known_vectors(former, embedding), folder)
        fresh = materialize(reuse_vectors(fresh, known, embedding), "fresh")
        remove_folder(store.documents.sparkSession, folder)
        reused = fresh.where("embedding is not null").count()
        work = fresh.unionByName(materialize(kept.join(stale, "source_id", "left_semi"), "stale-chunks"))
        kept = kept.join(stale, "source_id", "left_anti")
        work, embedded, warning = embed_missing(work, documents, embed, embedding)
        embedded += 0 if warning else reused
    else:
        differing = materialize(differing, "differing")
        work = materialize(fresh.select(*columns), "chunks")
    chunks = kept.unionByName(work)
    summary = ingest_summary(plan, chunks, embedded, model, warning)
    changes = StoreChanges(store.version, documents.join(differing, "source_id", "left_semi"), work, differing)
    return IngestOutcome(Store(documents, chunks), plan, summary, changes, reused)


def _text_hash(embedding: EmbeddingOptions) -> Column:
    return F.sha2(embedding_text(F.col("title"), F.col("section_path"), F.col("content"), embedding.document_prefix), 256).alias("text_hash")


def known_vectors(former: Store, embedding: EmbeddingOptions) -> DataFrame:
    """``source_id, text_hash, known``: the vectors of this model that ``former`` chunks have, by hash of their embedding texts.

    Of repeated texts with different vectors the least counts. Written apart, so that the former texts, and what was shuffled
    of them, are gone when the new ones are shuffled.
    """
    usable = former.chunks.where(~embedding_pending(embedding.model))
    titled = usable.join(former.documents.select("source_id", "title"), "source_id")
    return titled.select("source_id", _text_hash(embedding), "embedding").groupBy("source_id", "text_hash").agg(F.min("embedding").alias("known"))


def reuse_vectors(fresh: DataFrame, known: DataFrame, embedding: EmbeddingOptions) -> DataFrame:
    """``fresh`` chunks (with ``title``), with the ``known`` vector of the document for the same embedding text.

    A document's chunks spread over the hashes of their texts, so a huge document is no single task.
    """
    columns = CHUNK_SCHEMA.replace(",", "").split()[0::2]
    hashed = fresh.select(*columns, _text_hash(embedding))
    met = hashed.join(known, ["source_id", "text_hash"], "left").withColumn("embedding", F.col("known"))
    return met.withColumn("embedding_model", F.when(F.col("known").isNotNull(), F.lit(embedding.model))).select(*columns)


def embed_missing(
    chunks: DataFrame, documents: DataFrame, embed: EmbedFn, embedding: EmbeddingOptions
) -> tuple[DataFrame, int, str | None]:
    """Vectors for ``chunks`` (a written table) that have none from this model: all of them, or none and a warning.

    Chunks that have one are not written again.
    """
    columns = CHUNK_SCHEMA.replace(",", "").split()[0::2]
    marked = chunks.withColumn("pending", embedding_pending(embedding.model))
    texts = marked.where("pending").join(documents.select("source_id", "title"), "source_id").select(
        *columns,
        embedding_text(F.col("title"), F.col("section_path"), F.col("content"), embedding.document_prefix).alias("embed_text"),
    )
    tried = materialize(embed_texts(texts, embed, embedding.batch_size).drop("embed_text"), "embedded")
    failed, count = tried.agg(F.count_if(F.col("embed_error").isNotNull()), F.count(F.lit(1))).first()
    settled = marked.where(~F.col("pending")).select(*columns)
    if failed:
        return settled.unionByName(tried.select(*columns)), 0, EMBEDDING_UNAVAILABLE
    renewed = tried.withColumn("embedding", F.col("vector")).withColumn("embedding_model", F.lit(embedding.model))
    return settled.unionByName(renewed.select(*columns)), count, None


def ingest_summary(plan: DataFrame, chunks: DataFrame, embedded: int, model: str | None, warning: str | None) -> DataFrame:
    """One row: documents, chunks, counts per action, embedded chunks, retrieval mode, warning."""
    names = ("documents", "added", "updated", "removed", "unchanged")
    actions = action_counts(plan).select(*names, F.lit(0).cast("bigint").alias("chunks"), F.lit(None).cast("string").alias("mode"))
    state = vectors_usable(chunks, model).select(*[F.lit(0).cast("bigint").alias(n) for n in names], "chunks", "mode")
    return actions.unionByName(state).agg(
        *[F.sum(n).alias(n) for n in ("documents", "chunks", "added", "updated", "removed", "unchanged")],
        F.lit(embedded).cast("bigint").alias("embedded_chunks"),
        F.max("mode").alias("retrieval_mode"),
        F.lit(warning).cast("string").alias("warning"),
    )
