"""Versions of a store as segments: what they hold, what is written, and that joins by document move nothing."""

import pytest
from pyspark.sql import functions as F

from helpers import files, markdown, store
from lexifold import EmbeddingOptions, StoreChanges, StoreMoved, document_detail, empty_store, ingest, read_store, write_changes, write_store
from lexifold.sources import store as store_module
from lexifold.sources.store import REPLACED_SCHEMA, documents_with_chunks


def doc(name, *sections, version="1.0"):
    return (name, name, version, "2025-01-01", "active", "sss", f"Belge {name}", [(f"B{i}", text) for i, text in enumerate(sections)])


def changes(spark, base, documents, replaced):
    fresh = store(spark, *documents) if documents else empty_store(spark)
    return StoreChanges(base.version, fresh.documents, fresh.chunks, spark.createDataFrame([(r,) for r in replaced], REPLACED_SCHEMA))


def content(stored):
    return sorted((r.source_id, r.version, r.chunk_order, r.content) for r in documents_with_chunks(stored).collect())


def in_segment(spark, path, stored, name):
    return sorted(r.id for r in spark.read.parquet(f"{path}/{stored.version.segments[-1]}/{name}").collect())


def test_segments(spark, tmp_path):
    path = str(tmp_path / "it's a store")
    first = write_store(store(spark, doc("a", "bir", "iki"), doc("b", "üç"), doc("c")), path)
    second = write_changes(changes(spark, first, [doc("b", "dört", "beş", version="2"), doc("d", "altı")], ["b", "d"]), path)
    assert (second.version.number, len(second.version.segments)) == (2, 2)
    assert in_segment(spark, path, second, "documents") == ["b", "d"]
    assert in_segment(spark, path, second, "chunks") == ["b", "b", "d"]
    expected = [("a", "1.0", 0, "bir"), ("a", "1.0", 1, "iki"), ("b", "2", 0, "dört"), ("b", "2", 1, "beş"), ("c", "1.0", None, None), ("d", "1.0", 0, "altı")]
    assert content(second) == expected
    # Removed, added again, and replaced once more: the last segment counts.
    third = write_changes(changes(spark, second, [], ["a", "b", "no such id"]), path)
    assert content(third) == [r for r in expected if r[0] in "cd"]
    fourth = write_changes(changes(spark, third, [doc("a", "yeni"), doc("d")], ["a", "d"]), path)
    assert content(fourth) == [("a", "1.0", 0, "yeni"), ("c", "1.0", None, None), ("d", "1.0", None, None)]
    # Former versions can still be read, and nothing changes without a change.
    assert content(second) == expected
    assert content(write_changes(changes(spark, fourth, [], []), path)) == content(fourth) == content(read_store(spark, path))


def test_changes_of_a_former_version_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    first = write_store(store(spark, doc("a", "bir")), path)
    late = changes(spark, first, [doc("a", "geç")], ["a"])
    second = write_changes(changes(spark, first, [doc("b", "iki")], ["b"]), path)
    with pytest.raises(StoreMoved):
        write_changes(late, path)
    assert content(read_store(spark, path)) == content(second) == [("a", "1.0", 0, "bir"), ("b", "1.0", 0, "iki")]


def test_many_segments_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MAX_SEGMENTS", 3)
    path = str(tmp_path / "store")
    stored = write_changes(changes(spark, read_store(spark, path), [doc("a", "0")], ["a"]), path)
    sizes = []
    for step in range(1, 6):
        stored = write_changes(changes(spark, stored, [doc("a", str(step)), doc(f"n{step}")], ["a", f"n{step}"]), path)
        sizes.append(len(stored.version.segments))
    assert sizes == [2, 3, 1, 2, 3]
    assert content(stored) == [("a", "1.0", 0, "5"), *[(f"n{i}", "1.0", None, None) for i in range(1, 6)]]


def test_ingest_writes_what_changed(spark, tmp_path):
    path = str(tmp_path / "store")
    texts = {n: markdown(n, f"## Bölüm\n\n{n} metni.\n") for n in "abcdefgh"}
    calls = spark.sparkContext.accumulator(0)

    def embed(batch):
        calls.add(len(batch))
        return [[float(len(t)), 1.0] for t in batch]

    first = write_changes(ingest(files(spark, **texts), read_store(spark, path), embed, EmbeddingOptions("m")).changes, path)
    assert calls.value == 8
    texts["c"] = markdown("C", "## Bölüm\n\nyeni.\n\n## İkinci\n\nmetin.\n")
    del texts["h"]
    outcome = ingest(files(spark, **texts), first, embed, EmbeddingOptions("m"))
    assert calls.value == 10
    second = write_changes(outcome.changes, path)
    assert in_segment(spark, path, second, "documents") == ["c"]
    assert in_segment(spark, path, second, "chunks") == ["c", "c"]
    assert in_segment(spark, path, second, "replaced") == ["c", "h"]
    assert content(second) == content(outcome.store)
    assert second.chunks.where("embedding is null").count() == 0
    # Another model: every document is written again, as its vectors are new.
    other = write_changes(ingest(files(spark, **texts), second, embed, EmbeddingOptions("m2")).changes, path)
    assert in_segment(spark, path, other, "documents") == list("abcdefg")
    assert {r.embedding_model for r in other.chunks.collect()} == {"m2"}
    assert content(other) == content(second)


@pytest.mark.parametrize("n_segments", [1, 3])
def test_joins_by_document_move_no_row(spark, tmp_path, n_segments):
    path = str(tmp_path / "store")
    stored = write_store(store(spark, *[doc(f"d{i}", "metin", "iki") for i in range(20)]), path)
    for step in range(n_segments - 1):
        stored = write_changes(changes(spark, stored, [doc(f"d{step}", "yeni")], [f"d{step}"]), path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = documents_with_chunks(stored)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("Exchange rangepartitioning") == 1
        per_document = stored.chunks.groupBy("source_id").agg(F.count(F.lit(1)))
        assert "Exchange" not in per_document._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(content(stored)) == 40 - (n_segments - 1)
    detail = document_detail(stored, spark.createDataFrame([("d0",), ("d19",)], "requested_id string")).collect()
    assert [(r.source_id, r.content) for r in detail] == ([("d0", "metin"), ("d0", "iki")] if n_segments == 1 else [("d0", "yeni")]) + [("d19", "metin"), ("d19", "iki")]
