"""An index brought up to date against one built anew."""

import os
import random

import pytest
from helpers import garden_store, queries, store
from lexifold.plans import index as index_plan
from lexifold.plans import segments
from lexifold.plans.index import build_index, load_index
from lexifold.plans.search import prepare, search
from lexifold.sources.store import Store
from pyspark.sql import functions as F


def word(n):
    return "".join("abcdefghij"[n // 10**k % 10] for k in range(5))


def document(name, seed):
    rng = random.Random(seed)
    sections = [(f"Bolum {k}", " ".join(word(rng.randrange(300)) for _ in range(rng.randrange(3, 40)))) for k in range(rng.randrange(1, 4))]
    return (name, name, "1.0", "2024-01-01", "active", "sss", f"Belge {name}", sections)


ASKED = [f"{word(i)} {word(i + 1)} {word(3 * i)}" for i in range(12)]


def state(index):
    """Everything a search can see, without numbers."""
    names = index.versions.select("doc_no", "source_id")
    result = search(index, prepare(index, queries(index.versions.sparkSession, *ASKED)), top_k=20)
    hits = result.hits.join(names, "doc_no").drop("doc_no")
    return (
        (index.n_documents, index.n_chunks, index.n_terms, index.mode),
        {tuple(r) for r in index.terms.select("term", "df").collect()},
        {tuple(r) for r in index.postings.join(names, "doc_no").select("source_id", "chunk_order", "dl", "term", "tf").collect()},
        [r["file_name"] for r in index.versions.orderBy("doc_no").collect()],
        {tuple(r) for r in hits.select(*sorted(hits.columns)).collect()},
        {tuple(r) for r in result.stats.collect()},
    )


def same(spark, index, documents):
    anew = build_index(store(spark, *documents), buckets=index.buckets)
    for one, other in zip(state(index), state(anew), strict=True):
        assert one == other


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_id string")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_added_updated_and_removed(spark, tmp_path):
    now = {f"d{i:03d}": document(f"d{i:03d}", i) for i in range(0, 300, 2)}
    first = index = build_index(store(spark, *now.values()), buckets=3, path=str(tmp_path / "first"))
    before = state(first)
    now["a-new"], now["d004x"], now["z-last"] = document("a-new", 1001), document("d004x", 1002), document("z-last", 1003)
    now["d010"] = document("d010", 1004)
    del now["d020"], now["d298"]
    changed = ids(spark, "a-new", "d004x", "z-last", "d010", "d020", "d298", "nobody", "a-new")
    index = segments.update_index(index, store(spark, *now.values()), changed, path=str(tmp_path / "second"))
    assert index.n_dead == 3 and len(index.segments) == 2
    same(spark, index, now.values())
    # a second time, documents of the second segment included
    now["d010"], now["d011"] = document("d010", 1005), document("d011", 1006)
    del now["z-last"]
    index = segments.update_index(index, store(spark, *now.values()), ids(spark, "d010", "d011", "z-last"))
    same(spark, index, now.values())
    assert state(first) == before  # an index that is being read never changes
    merged = segments.merge_segments(index, str(tmp_path / "merged"))
    assert merged.segments == (str(tmp_path / "merged"),) and merged.n_dead == 0
    assert state(merged) == state(index)
    # scores of a document are still summed where its postings lie
    per_chunk = index.postings.groupBy("doc_no", "chunk_order").count()
    assert "Exchange hashpartitioning" not in per_chunk._jdf.queryExecution().executedPlan().toString()


def test_writes_follow_the_change(spark, tmp_path):
    now = {f"d{i:04d}": document(f"d{i:04d}", i) for i in range(1500)}
    index = build_index(store(spark, *now.values()), buckets=2, path=str(tmp_path / "whole"))
    for i in range(7, 1500, 100):
        now[f"d{i:04d}"] = document(f"d{i:04d}", 5000 + i)
    changed = [f"d{i:04d}" for i in range(7, 1500, 100)]
    later = segments.update_index(index, store(spark, *now.values()), ids(spark, *changed), path=str(tmp_path / "part"))
    rows = [spark.read.parquet(str(tmp_path / f / "postings")).count() for f in ("whole", "part")]
    assert rows[1] < 0.02 * rows[0]
    assert size(tmp_path / "part" / "chunks") < 0.1 * size(tmp_path / "whole" / "chunks")
    assert (later.n_documents, later.n_chunks) == (1500, later.chunks.count())


def test_nothing_changes_and_everything_does(spark):
    now = [document(f"d{i}", i) for i in range(5)]
    index = build_index(store(spark, *now), buckets=2)
    same(spark, segments.update_index(index, store(spark, *now), ids(spark, "nobody")), now)
    empty = segments.update_index(index, store(spark), ids(spark, *[d[0] for d in now]))
    assert (empty.n_documents, empty.n_chunks, empty.n_terms, empty.average_length) == (0, 0, 0, 1.0)
    full = segments.update_index(empty, store(spark, *now), ids(spark, *[d[0] for d in now]))
    same(spark, full, now)
    assert load_index(spark, full.path).segments == full.segments


def test_no_room_between_neighbours(spark, monkeypatch):
    monkeypatch.setattr("lexifold.plans.index.GAP_BITS", 1)
    now = [document(f"d{i}", i) for i in range(4)]
    index = build_index(store(spark, *now), buckets=2)
    more = now + [document(f"d1x{i}", 10 + i) for i in range(5)]
    changed = ids(spark, *[f"d1x{i}" for i in range(5)])
    with pytest.raises(segments.NoRoom):
        segments.update_index(index, store(spark, *more), changed)
    same(spark, segments.refresh_index(index, store(spark, *more), changed), more)


def test_vectors_of_another_model(spark):
    def with_model(name, n):
        return store(spark, *[(f"d{i}", f"d{i}", "1.0", "2024-01-01", "active", "sss", "T", [("B", f"metin {i}", [1.0, float(i)], name)]) for i in range(n)])

    index = build_index(with_model("m1", 4), model="m1", buckets=2)
    assert index.mode == "hybrid"
    both = with_model("m1", 4)
    added = with_model("m2", 5)
    mixed = Store(added.documents, both.chunks.unionByName(added.chunks.where(F.col("source_id") == "d4")))
    later = segments.update_index(index, mixed, ids(spark, "d4"), model="m1")
    assert (later.mode, later.n_usable, later.n_chunks) == ("lexical", 4, 5)
    assert segments.update_index(index, mixed, ids(spark, "nobody"), model="m2").n_usable == 0
    right = segments.update_index(later, with_model("m1", 5), ids(spark, "d4"), model="m1")
    assert (right.mode, right.n_usable) == ("hybrid", 5)


def test_no_frame_is_gone_through_anew_for_each_row(spark):
    now = [document(f"d{i}", i) for i in range(5)]
    index = build_index(store(spark, *now), buckets=2)
    numbered = segments.number_between(index.versions.select("file_name", "doc_no"), store(spark, document("d2x", 9)).documents)
    assert "unboundedfollowing" not in numbered._jdf.queryExecution().analyzed().toString().lower()
    taken = {r.source_id: r.doc_no for r in index.versions.collect()}
    assert [taken["d2"] < r.doc_no < taken["d3"] for r in numbered.collect()] == [True]


def test_texts_of_a_segment_are_written_in_waves(spark, monkeypatch):
    """As many waves as documents need, each with its own part of them; the index and what is found in it are the same."""
    documents = garden_store(spark)
    asked = queries(spark, "anahtar parsel", "kompost")
    written, write = [], index_plan.write_bucketed_parts
    monkeypatch.setattr(index_plan, "write_bucketed_parts", lambda parts, *rest: written.append([p.count() for p in parts]) or write(parts, *rest))

    def seen(index):
        hits = search(index, prepare(index, asked)).hits.collect()
        tables = [sorted(map(str, t.collect())) for t in (index.chunks, index.postings, index.terms, index.versions)]
        return sorted(map(str, hits)), tables, index.summary.drop("built_at", "segments").collect()

    whole = build_index(documents, buckets=3)
    monkeypatch.setattr(index_plan, "DOCUMENTS_PER_WAVE", 2)
    waves = build_index(documents, buckets=3)
    assert seen(waves) == seen(whole)
    n = documents.documents.count()
    assert [len(w) for w in written] == [1, -(-n // 2)] and sum(written[0]) == sum(written[1])
    assert "Exchange hashpartitioning" not in waves.chunks.groupBy("doc_no").count()._jdf.queryExecution().executedPlan().toString()
