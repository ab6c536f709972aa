import datetime
import os

import pytest

from helpers import files, markdown
from lexifold import (
    EmbeddingOptions,
    IngestRejected,
    build_index,
    document_detail,
    document_versions,
    empty_store,
    ingest,
    list_documents,
    read_store,
    status,
    write_store,
)
from lexifold.sources.scratch import scratch_run, shared_folder

MODEL = EmbeddingOptions(model="m1", batch_size=2)
RETURNS = markdown("iade", "## İade Süresi\n\n30 gün.\n\n## Para İadesi\n\n5 iş günü.\n")
SHIPPING = markdown("kargo", "## Kargo Ücreti\n\n750 TL üzeri ücretsiz.\n")


def embed(texts):
    assert len(texts) <= 2
    return [[float(len(t)), 1.0] for t in texts]


def summary(outcome):
    return outcome.summary.first().asDict()


def test_life_of_a_store(spark, tmp_path):
    path = str(tmp_path / "store")
    day = [datetime.datetime(2025, 1, d) for d in range(1, 5)]
    first = ingest(files(spark, iade=RETURNS, kargo=SHIPPING), read_store(spark, path), embed, MODEL, run_at=day[0])
    assert summary(first) == {"documents": 2, "chunks": 3, "added": 2, "updated": 0, "removed": 0, "unchanged": 0,
                              "embedded_chunks": 3, "retrieval_mode": "hybrid", "warning": None}
    stored = write_store(first.store, path)
    assert build_index(stored, model="m1").mode == "hybrid"

    again = ingest(files(spark, iade=RETURNS, kargo=SHIPPING.replace("\n", "\r\n")), stored, embed, MODEL, run_at=day[1])
    assert (lambda s: (s["unchanged"], s["added"], s["embedded_chunks"], s["retrieval_mode"]))(summary(again)) == (2, 0, 0, "hybrid")
    stored = write_store(again.store, path)

    changed = markdown("KARGO", "## Kargo Ücreti\n\n1000 TL üzeri ücretsiz.\n")
    third = ingest(files(spark, iade=RETURNS, kargo=changed), stored, embed, MODEL, run_at=day[2])
    assert (lambda s: (s["updated"], s["unchanged"], s["embedded_chunks"]))(summary(third)) == (1, 1, 1)
    stored = write_store(third.store, path)
    documents = {r.source_id: r for r in stored.documents.collect()}
    assert set(documents) == {"iade", "kargo"}  # the stored spelling survives
    assert documents["kargo"].title == "Belge KARGO"
    assert (documents["kargo"].created_at, documents["kargo"].updated_at) == (day[0], day[2])
    assert documents["iade"].updated_at is None
    assert [(c.section_path, c.content, len(c.embedding)) for c in stored.chunks.where("source_id = 'kargo'").collect()] == [
        ("Kargo Ücreti", "1000 TL üzeri ücretsiz.", 2)]

    other_model = ingest(files(spark, iade=RETURNS, kargo=changed), stored, embed, EmbeddingOptions(model="m2", batch_size=2))
    assert summary(other_model)["embedded_chunks"] == 3

    last = ingest(files(spark, iade=RETURNS), stored, embed, MODEL)
    assert summary(last)["removed"] == 1 and summary(last)["chunks"] == 2
    stored = write_store(last.store, path)
    assert {r.source_id for r in stored.chunks.collect()} == {"iade"}
    assert read_store(spark, path).documents.count() == 1


def test_failing_embedder_leaves_a_lexical_store(spark):
    def down(texts):
        raise ConnectionError("refused")

    outcome = ingest(files(spark, iade=RETURNS, kargo=SHIPPING), empty_store(spark), down, MODEL)
    row = summary(outcome)
    assert (row["embedded_chunks"], row["retrieval_mode"], row["warning"]) == (0, "lexical", "embedding_unavailable")
    assert outcome.store.chunks.where("embedding is not null").count() == 0

    calls = ingest(files(spark, iade=RETURNS, kargo=SHIPPING), empty_store(spark), lambda texts: [[1.0]], MODEL)
    assert summary(calls)["chunks"] == 3


def test_vectors_of_same_texts_are_kept(spark):
    sent = spark.sparkContext.accumulator(0)

    def counted(texts):
        sent.add(len(texts))
        return embed(texts)

    before = markdown("a", "## Bir\n\nilk metin\n\n## Iki\n\nayni\n\n## Iki\n\nayni\n")
    first = ingest(files(spark, a=before, b=RETURNS), empty_store(spark), counted, MODEL).store
    assert sent.value == 5
    # A section before the others, one text changed: the repeated texts keep their vectors at their new places.
    after = markdown("a", "## Sifir\n\nyeni\n\n## Bir\n\nbaska metin\n\n## Iki\n\nayni\n\n## Iki\n\nayni\n")
    second = ingest(files(spark, a=after, b=RETURNS), first, counted, MODEL)
    assert (sent.value, second.reused_vectors, summary(second)["embedded_chunks"]) == (7, 2, 4)
    anew = ingest(files(spark, a=after, b=RETURNS), empty_store(spark), embed, MODEL).store

    def rows(store):
        return sorted((r.source_id, r.chunk_order, r.content, tuple(r.embedding), r.embedding_model) for r in store.chunks.collect())

    assert rows(second.store) == rows(anew)
    # Another title or another model is another text: nothing is reused.
    titled = markdown("a", "## Iki\n\nayni\n", title="Baska")
    assert ingest(files(spark, a=titled, b=RETURNS), first, embed, MODEL).reused_vectors == 0
    other = ingest(files(spark, a=after, b=RETURNS), first, embed, EmbeddingOptions(model="m2", batch_size=2))
    assert (other.reused_vectors, summary(other)["embedded_chunks"]) == (0, 6)


def test_no_embedder(spark):
    row = summary(ingest(files(spark, iade=RETURNS), empty_store(spark)))
    assert (row["embedded_chunks"], row["retrieval_mode"], row["warning"]) == (0, "lexical", None)


@pytest.mark.parametrize(
    ("texts", "code", "detail"),
    [
        ({"a": RETURNS, "b": markdown("Iade", "## A\nmetin"), "c": markdown("x", "## A\nmetin")}, "duplicate_document_id", "iade"),
        ({"b": "bozuk", "a": markdown("a", ""), "c": RETURNS}, "section_missing", "a.md"),
    ],
)
def test_rejected_sources(spark, texts, code, detail):
    with pytest.raises(IngestRejected) as rejected:
        ingest(files(spark, **texts), empty_store(spark))
    assert (rejected.value.code, rejected.value.detail) == (code, detail)


def test_empty_source_is_rejected(spark):
    with pytest.raises(IngestRejected, match="knowledge_base_empty"):
        ingest(spark.createDataFrame([], "file_name string, text string"), empty_store(spark))


def test_catalogue_reads(spark):
    v1 = markdown("iade-v1", "## A\nbir", key="iade", date="2024-01-15", status="superseded")
    v2 = markdown("iade-v2", "## B\niki\n\n## A\nüç", key="iade", version="2.0", date="2025-06-01", supersedes="iade-v1")
    store = ingest(files(spark, b=v2, a=v1, kargo=SHIPPING), empty_store(spark)).store
    assert [(r.source_id, r.section_count, r.supersedes) for r in list_documents(store).collect()] == [
        ("iade-v1", 1, None), ("iade-v2", 2, "iade-v1"), ("kargo", 1, None)]
    wanted = spark.createDataFrame([(" iade-v2 ",), ("yok",), ("IADE-V1",)], "requested_id string")
    detail = document_detail(store, wanted)
    assert [(r.source_id, r.http_status, r.section_path) for r in detail.collect()] == [
        ("IADE-V1", 404, None), ("iade-v2", 200, "B"), ("iade-v2", 200, "A"), ("yok", 404, None)]
    index = build_index(store)
    assert [(r.document_key, r.source_id, r.n_versions) for r in document_versions(index.versions).collect()] == [
        ("iade", "iade-v1", 2), ("iade", "iade-v2", 2), ("kargo", "kargo", 1)]
    assert status(index, spark, generator="g").first().asDict() == {
        "status": "ok", "ready": True, "documents": 3, "sections": 4, "retrieval_mode": "lexical",
        "generator_configured": True, "embedder_configured": False}
    assert status(None, spark).first()["status"] == "degraded"


def test_chunks_with_a_vector_are_written_once(spark):
    """Of an update only the chunks without a known vector are written again, and the known vectors go when met."""
    before = markdown("a", "## Bir\n\nilk metin\n\n## Iki\n\nayni\n")
    first = ingest(files(spark, a=before, b=RETURNS), empty_store(spark), embed, MODEL).store
    with scratch_run(spark):
        runs = f"{shared_folder(spark)}/lexifold"
        was = set(os.listdir(runs))
        second = ingest(files(spark, a=before + "\n## Uc\n\nyeni\n", b=RETURNS), first, embed, MODEL)
        (run,) = {r for r in set(os.listdir(runs)) - was} or {max(os.listdir(runs), key=lambda r: os.path.getmtime(f"{runs}/{r}"))}
        tables = [n.rsplit("-", 1) for n in os.listdir(f"{runs}/{run}")]
        rows = {name: sum(spark.read.parquet(f"{runs}/{run}/{name}-{code}").count() for n, code in tables if n == name) for name, _ in tables}
        assert "known-vectors" not in rows and "settled" not in rows
        assert (rows["fresh"], rows["embedded"], second.reused_vectors) == (3, 1, 2)
        assert second.store.chunks.where("embedding is null").isEmpty() and second.store.chunks.count() == 5
