"""Search by block maxima: the pool of a full scoring, from few blocks."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import queries, store
from lexifold.operators import bm25
from lexifold.operators.bm25 import best_matches, block_maxima, match_bounds, pool_by_blocks, pool_by_matrices, score_matches
from lexifold.options import RetrievalOptions
from lexifold.plans.index import build_index
from lexifold.plans.search import prepare, search
from pyspark.sql import functions as F


def word(n):
    """Words are told apart by their first five letters."""
    return "".join("abcdefghij"[n // 10**k % 10] for k in range(5))


def topic(t, i):
    return word(1000 + 30 * t + i)


def shared(i):
    return word(i)


@pytest.fixture(scope="module")
def index(spark):
    """Documents by topic in file-name order: words of the topic, and words that all documents have."""
    rng = random.Random(1)
    topics = [[topic(t, i) for i in range(30)] for t in range(40)]
    everywhere = [shared(i) for i in range(60)]
    documents = []
    for n in range(3000):
        words = rng.choices(topics[n * 40 // 3000], k=rng.randrange(5, 30)) + rng.choices(everywhere, k=rng.randrange(5, 40))
        rng.shuffle(words)
        documents.append((f"b{n:05d}", f"b{n:05d}", "1.0", "2024-01-01", "active", "sss", "Baslik", [("Bolum", " ".join(words))]))
    return build_index(store(spark, *documents), buckets=2)


def by_full_scoring(index, prepared, postings, pool, options):
    scored = score_matches(postings, prepared.terms, index.average_length, n_terms=prepared.n_terms, options=options)
    bounds = match_bounds(scored, pool)
    ranked = {tuple(r) for r in best_matches(scored, bounds, pool).select("query_id", "rank", "doc_no", "chunk_order", "score", "coverage").collect()}
    return ranked, {tuple(r) for r in bounds.select("query_id", "max_coverage").collect()}


def of(found):
    columns = ("query_id", "rank", "doc_no", "chunk_order", "score", "coverage")
    return {tuple(r) for r in found.ranked.select(*columns).collect()}, {tuple(r) for r in found.coverage.collect()}


@pytest.mark.parametrize("most", [500_000, 3])
def test_few_blocks_are_scored(spark, index, most):
    options = RetrievalOptions(max_broadcast_rows=most)
    asked = queries(spark, f"{topic(3, 1)} {topic(3, 2)} {shared(4)}", f"{topic(17, 5)} {shared(1)}", f"{topic(30, 0)} {topic(30, 9)} {topic(30, 3)}", "yok", "")
    prepared = prepare(index, asked)
    found = pool_by_blocks(index.postings, index.blocks, prepared.terms, index.average_length, n_terms=prepared.n_terms, pool=5, options=options)
    assert of(found) == by_full_scoring(index, prepared, index.postings, 5, options)
    if most > 3:
        assert found.n_blocks > 60 and found.n_scored < found.n_blocks / 4
    else:
        assert found.n_scored == found.n_blocks


def test_nothing_to_tell_blocks_apart_by(spark, index):
    prepared = prepare(index, queries(spark, *[f"{shared(i)} {shared(i + 1)} {shared(i + 7)} {topic(1, i)}" for i in range(12)]))
    found = search(index, prepared).lexical
    assert of(found) == by_full_scoring(index, prepared, index.postings, 20, RetrievalOptions())


def test_filtered_postings_have_bounds_that_are_too_high_only(spark, index):
    allowed = index.postings.where(F.col("doc_no") % 3 != 0)
    prepared = prepare(index, queries(spark, f"{topic(8, 4)} {shared(9)}", f"{topic(8, 4)} {topic(22, 1)}"))
    found = pool_by_blocks(allowed, index.blocks, prepared.terms, index.average_length, n_terms=prepared.n_terms, pool=20)
    assert of(found) == by_full_scoring(index, prepared, allowed, 20, RetrievalOptions())


def test_a_block_lies_in_one_bucket_and_bounds_hold(index):
    blocks = index.postings.select("block", F.pmod(F.hash("doc_no"), F.lit(index.buckets)).alias("bucket"), "doc_no").distinct()
    sizes = blocks.groupBy("block").agg(F.countDistinct("bucket").alias("buckets"), F.countDistinct("doc_no").alias("documents")).collect()
    assert {r["buckets"] for r in sizes} == {1} and max(r["documents"] for r in sizes) <= 100 and len(sizes) > 30
    beyond = index.postings.join(index.blocks, ["term", "block"]).where("tf > max_tf or dl < min_dl")
    assert beyond.isEmpty()


def test_matches_are_not_shuffled(spark, index):
    prepared = prepare(index, queries(spark, f"{topic(3, 1)} {shared(4)}"))
    scored = score_matches(index.postings, prepared.terms, index.average_length, n_terms=prepared.n_terms)
    assert "Exchange hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [500_000, 40])
def test_many_queries_are_scored_by_matrices(spark, index, most, monkeypatch):
    for name, value in (("CHUNKS_AT_ONCE", 64), ("QUERIES_AT_ONCE", 5), ("PRODUCTS_AT_ONCE", 50)):
        monkeypatch.setattr(f"lexifold.operators.bm25.{name}", value)
    texts = [f"{shared(i)} {shared(i + 1)} {topic(i, i % 30)} {topic(i, 3)} {topic(1, 2)}" for i in range(12)]
    prepared = prepare(index, queries(spark, *texts, topic(5, 5), "yok", "", shared(3)))
    options = RetrievalOptions(max_broadcast_rows=most)
    found = pool_by_matrices(index.postings, prepared.terms, index.average_length, n_terms=prepared.n_terms, pool=7, options=options)
    assert of(found) == by_full_scoring(index, prepared, index.postings, 7, options)
    assert "Exchange hashpartitioning" not in plan_of_chunks(index, prepared)
    many = search(index, prepared, options=RetrievalOptions(max_bounded_terms=1))
    few = search(index, prepared)
    assert many.lexical.n_blocks is None and few.lexical.n_blocks > 0
    rows = lambda r: ({tuple(x) for x in r.hits.collect()}, {tuple(x) for x in r.stats.collect()})
    assert rows(many) == rows(few)


def plan_of_chunks(index, prepared):
    met = index.postings.join(F.broadcast(prepared.terms.select("term").distinct()), "term").groupBy("doc_no", "chunk_order", "dl")
    plan = met.agg(F.collect_list("tf"))._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line for line in plan.split("\n") if "doc_no" in line)


def test_maxima_are_taken_bucket_by_bucket(index):
    plan = block_maxima(index.postings)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("pool, copies", [(20, 1), (20, 7), (7, 400)])
def test_matrices_score_few_pairs_exactly_and_keep_the_best(monkeypatch, pool, copies):
    """Estimates in single precision choose; scores, coverage and ties are as by plain sums."""
    rng = np.random.default_rng(4)
    n_terms, n_queries = 900, 60
    weight = np.log1p(np.arange(1, n_terms + 1) / 9.0)  # frequent terms first
    likely = 1 / np.arange(1, n_terms + 1)
    asked = [np.sort(rng.choice(n_terms, rng.integers(1, 30), replace=False, p=likely / likely.sum())) for _ in range(n_queries)]
    chunks = [np.unique(rng.choice(n_terms, rng.integers(5, 90), p=likely / likely.sum())) for _ in range(4_000 // copies)] * copies
    tfs = [rng.integers(1, 4, len(c)) for c in chunks[: len(chunks) // copies]] * copies
    totals = [float(weight[q].sum()) for q in asked]
    rows = pa.table({
        "query_id": pa.array(np.repeat(np.arange(n_queries), [len(q) for q in asked])), "term": pa.array([f"t{t}" for q in asked for t in q]),
        "idf": pa.array(np.concatenate([weight[q] for q in asked])), "total_idf": pa.array(np.repeat(totals, [len(q) for q in asked])),
    })
    block = bm25._asked(rows)
    number = {t: i for i, t in enumerate(block["terms"].to_pylist())}
    met = [[(number[f"t{t}"], int(f)) for t, f in zip(c, tf, strict=True) if f"t{t}" in number] for c, tf in zip(chunks, tfs, strict=True)]
    met = pa.RecordBatch.from_pydict({
        "doc_no": pa.array(range(len(chunks)), pa.int64()), "chunk_order": pa.array([0] * len(chunks), pa.int32()), "dl": pa.array([int(tf.sum()) for tf in tfs], pa.int32()),
        "numbers": pa.array([[n for n, _ in m] for m in met], pa.list_(pa.int32())), "tfs": pa.array([[f for _, f in m] for m in met], pa.list_(pa.int64())),
    })
    exact, scored = bm25._Matches.exact, []
    monkeypatch.setattr(bm25._Matches, "exact", lambda self, query, chunk: scored.append(len(query)) or exact(self, query, chunk))
    average, options = 40.0, RetrievalOptions()
    out = pa.Table.from_batches(list(bm25._pool_of_task(SimpleNamespace(value=block), average, pool, options)(iter([met.slice(0, 1500), met.slice(1500)])))).to_pylist()

    for i, q in enumerate(asked):
        found = []
        for d, (c, tf) in enumerate(zip(chunks, tfs, strict=True)):
            _, at, _ = np.intersect1d(c, q, assume_unique=True, return_indices=True)
            if len(at):
                w = weight[c[at]] * tf[at] * 2.2 / (tf[at] + 1.2 * (0.25 + 0.75 * tf.sum() / average))
                found.append((-round(float(w.sum()), 8), d, round(float(weight[c[at]].sum()) / totals[i], 8)))
        mine = [(-r["score"], r["doc_no"], r["coverage"]) for r in out if r["query_id"] == i and r["doc_no"] is not None]
        assert sorted(mine) == [pytest.approx(f, abs=2e-8) for f in sorted(found)[:pool]]
        assert [r["coverage"] for r in out if r["query_id"] == i and r["doc_no"] is None] == [pytest.approx(max(f[2] for f in found), abs=2e-8) for _ in found[:1]]
    if copies == 1:
        assert sum(scored) < n_queries * len(chunks) / 10
