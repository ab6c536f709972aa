import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import queries, garden_store, store
from lexifold import DEFAULTS, build_index, load_index, prepare, search, with_chunks
from lexifold.functions.vectors import cosine_similarity, unit_length
from lexifold.operators.bm25 import best_matches, match_bounds, score_matches, term_frequencies, weigh_query_terms
from lexifold.operators.dense import dense_scores, nearest_chunks
from lexifold.operators.fusion import fuse
from lexifold.plans.index import bucket_count
from lexifold.plans.search import of_terms, search_requests, search_within_documents, within

MODEL = "test-model"


def tiny_postings(spark):
    corpus = [["iade", "sures", "30", "gun"], ["kargo", "ucret", "750", "tl"], ["iade", "kargo", "ucret", "termo"]]
    rows = [(n, 0, 4, term, 1) for n, terms in enumerate(corpus) for term in terms]
    return spark.createDataFrame(rows, "doc_no bigint, chunk_order int, dl int, term string, tf bigint")


def weighed(spark, postings, *term_lists):
    rows = [(i, t) for i, terms in enumerate(term_lists) for t in dict.fromkeys(terms)]
    terms = spark.createDataFrame(rows, "query_id bigint, term string")
    return weigh_query_terms(terms, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), 3)


@pytest.mark.parametrize("most", [1000, 2])
def test_bm25_scores_and_coverage(spark, most):
    postings = tiny_postings(spark)
    terms = weighed(spark, postings, ["iade", "kargo"], ["iade", "sures"], ["kamera"], ["sures"], ["iade", "kamera"])
    rows = score_matches(postings, terms, 4.0, n_terms=terms.count(), options=type(DEFAULTS)(max_broadcast_rows=most)).collect()
    scores = {(r.query_id, r.doc_no): (r.score, r.coverage) for r in rows}
    best = {q: max((k for k in scores if k[0] == q), key=lambda k: scores[k][0])[1] for q in (0, 1, 3)}
    assert best == {0: 2, 1: 0, 3: 0}
    assert not any(q == 2 for q, _ in scores)
    assert [d for q, d in scores if q == 3] == [0]
    assert scores[1, 0][1] == 1.0
    assert scores[4, 0][1] == pytest.approx(0.184355, abs=1e-5)
    idf = math.log(1 + 2.5 / 1.5)
    assert scores[3, 0][0] == pytest.approx(idf * 2.2 / (1 + 1.2), abs=1e-7)


def test_rank_fusion(spark):
    words, near = [40, 41, 42, 43, 44], [43, 45, 41, 40]
    ranks = [(0, list_no, rank, item) for list_no, items in enumerate((words, near)) for rank, item in enumerate(items, start=1)]
    lists = spark.createDataFrame(ranks + [(1, 0, 1, 7), (1, 0, 2, 8), (1, 1, 1, 8), (1, 1, 2, 7)], "query_id int, list_no int, rank int, item int")
    rows = fuse(lists, ("item",), 10).orderBy("query_id", "rank").collect()
    score = {i: sum(1 / (11 + items.index(i)) for items in (words, near) if i in items) for i in {*words, *near}}
    fused = [(r.item, r.fused_score) for r in rows if r.query_id == 0]
    assert [i for i, _ in fused] == sorted(score, key=score.get, reverse=True)
    assert [f for _, f in fused] == pytest.approx(sorted(score.values(), reverse=True), rel=1e-9)
    # Equal scores: first seen wins.
    assert [r.item for r in rows if r.query_id == 1] == [7, 8]


def test_vector_expressions(spark):
    rows = spark.createDataFrame(
        [([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0])],
        "l array<float>, r array<float>",
    ).select(unit_length(F.col("l")).alias("u"), cosine_similarity(F.col("l"), F.col("r")).alias("c")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[1].u == [0.0, 0.0]
    assert [r.c for r in rows] == pytest.approx([1.0, 0.0, 0.0, 0.0])


@pytest.mark.parametrize("limit", [100, 30])
def test_nearest_chunks_equals_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8)).astype("float32")
    base[20:45] = base[20]  # a group of copies, so ties decide
    chunks = [(int(i // 3), int(i % 3), base[i].tolist()) for i in rng.permutation(60)]
    asked = rng.normal(size=(9, 8)).astype("float32")
    asked[0] = base[20]
    vectors = spark.createDataFrame(chunks, "doc_no bigint, chunk_order int, embedding array<float>").repartition(5)
    query_rows = [(i, asked[i].tolist()) for i in range(9)] + [(9, None)]
    asked_df = spark.createDataFrame(query_rows, "query_id bigint, vector array<float>")
    options = type(DEFAULTS)(max_broadcast_values=limit)
    got = nearest_chunks(vectors, asked_df, 6, options).collect()
    scores = base.astype(float) @ asked.astype(float).T
    scores /= np.linalg.norm(base.astype(float), axis=1)[:, None] * np.linalg.norm(asked.astype(float), axis=1)[None]
    scores = np.round(scores, 6)
    for q in range(9):
        expected = sorted(range(60), key=lambda i: (-scores[i, q], i))[:6]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.doc_no * 3 + r.chunk_order for r in mine] == expected
        assert [r.dense_score for r in mine] == pytest.approx([scores[i, q] for i in expected], abs=2e-6)
    assert not any(r.query_id == 9 for r in got)
    pairs = spark.createDataFrame([(0, 1), (3, 2)], "query_id bigint, doc_no bigint")
    near = {(r.query_id, r.doc_no, r.chunk_order): r.dense_score for r in dense_scores(vectors, asked_df, pairs).collect()}
    assert len(near) == 6 and near[3, 2, 1] == pytest.approx(scores[7, 3], abs=2e-6)


def test_index_tables_and_status(spark):
    index = build_index(garden_store(spark))
    assert (index.n_documents, index.n_chunks, index.mode) == (5, 7, "lexical")
    assert index.average_length == index.postings.agg(F.sum("tf")).first()[0] / 7
    assert [r.source_id for r in index.versions.orderBy("doc_no").collect()] == ["kompost", "parsel-2023", "parsel-2025", "parsel-2027", "soru-cevap"]
    again = load_index(spark, index.path)
    assert again.n_chunks == 7 and again.chunks.count() == 7 and again.built_at == index.built_at


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_nothing_is_shuffled_where_the_buckets_suffice(spark):
    index = build_index(garden_store(spark))
    prepared = prepare(index, queries(spark, "anahtar kompost"))
    scored = score_matches(index.postings, prepared.terms, index.average_length, n_terms=prepared.n_terms)
    assert exchanges(scored) == 0
    assert exchanges(term_frequencies(index.chunks)) == 0
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        allowed = within(index.postings, index.chunks.where("category = 'sss'"))
        filtered = score_matches(allowed, prepared.terms, index.average_length, n_terms=prepared.n_terms)
        assert "SortMergeJoin" in filtered._jdf.queryExecution().executedPlan().toString() and exchanges(filtered) == 0
        assert {r.doc_no for r in filtered.collect()} == {r.doc_no for r in index.versions.where("category = 'sss'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_best_matches_equal_a_plain_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), int(d), int(o), float(s), float(s) / 9) for q in range(4) for d in range(40) for o in range(2)
            if (s := rng.integers(0, 6 if q else 1)) >= 0 and (q < 3 or d < 3)]
    scored = spark.createDataFrame(rows, "query_id bigint, doc_no bigint, chunk_order int, score double, coverage double").repartition(7)
    bounds = match_bounds(scored, 5)
    got = {(r.query_id, r["rank"]): (r.doc_no, r.chunk_order) for r in best_matches(scored, bounds, 5).collect()}
    for q in range(4):
        expected = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1], r[2]))[:5]
        assert [got.get((q, i + 1)) for i in range(len(expected))] == [(r[1], r[2]) for r in expected]
    assert {r.query_id: r.max_coverage for r in bounds.collect()} == {q: max(r[4] for r in rows if r[0] == q) for q in range(4)}


def test_empty_corpus(spark):
    index = build_index(store(spark, ("a", "a", "1.0", "2025-01-01", "active", "sss", "A", [])))
    assert (index.n_chunks, index.average_length, index.mode) == (0, 1.0, "lexical")
    result = search(index, prepare(index, queries(spark, "iade")))
    assert result.hits.count() == 0
    assert result.stats.first().asDict() == {"query_id": 0, "mode": "lexical", "max_dense": 0.0, "max_coverage": 0.0}


def test_lexical_search(spark):
    index = build_index(garden_store(spark))
    result = search(index, prepare(index, queries(spark, "sabah damlama hattı", "zzzz", "anahtar depozitosu")), top_k=3)
    hits = with_chunks(index, result.hits).orderBy("query_id", "rank").collect()
    first = [h for h in hits if h.query_id == 0]
    assert [(h.source_id, h.section_path) for h in first] == [("parsel-2025", "Sulama")]
    assert first[0].dense_score is None and first[0].fused_score == pytest.approx(1 / 61)
    stats = {r.query_id: r for r in result.stats.collect()}
    assert stats[0].max_coverage == 1.0 and stats[1].max_coverage == 0.0 and stats[1].mode == "lexical"
    assert not any(h.query_id == 1 for h in hits) and sum(h.query_id == 2 for h in hits) == 3

    filtered = search(index, prepare(index, queries(spark, "anahtar depozitosu")), top_k=5, where=F.col("source_id") == "soru-cevap")
    found = with_chunks(index, filtered.hits).collect()
    assert [h.source_id for h in found] == ["soru-cevap"]
    whole = {(h.source_id, h.chunk_order): h.lexical_score for h in hits if h.query_id == 2}
    assert found[0].lexical_score == whole[found[0].source_id, found[0].chunk_order]


def test_search_with_its_checks(spark):
    index = build_index(garden_store(spark))
    rows = [(1, " anahtar ", None), (2, " ", 3), (3, "x" * 501, 3), (4, "anahtar", 0), (5, "anahtar", 1), (6, "anahtar", 21)]
    requests = spark.createDataFrame(rows, "query_id bigint, text string, top_k int")
    checked, result = search_requests(index, requests)
    codes = {r.query_id: (r.status, r.message_code) for r in checked.collect()}
    assert codes == {1: (200, None), 2: (400, "query_required"), 3: (400, "query_too_long"), 4: (400, "top_k_out_of_range"),
                     5: (200, None), 6: (400, "top_k_out_of_range")}
    counts = {r.query_id: r["count"] for r in result.hits.groupBy("query_id").count().collect()}
    assert counts == {1: 3, 5: 1}
    without, nothing = search_requests(None, requests)
    assert nothing is None and [r.status for r in without.orderBy("query_id").collect()] == [503, 400, 400, 400, 503, 400]
    with pytest.raises(ValueError, match="unique"):
        search_requests(index, requests.union(requests))


def hybrid_store(spark, model=MODEL):
    return store(
        spark,
        ("kargo", "kargo", "1.0", "2025-01-01", "active", "politika", "Kargo", [("Kargo Ücreti", "750 TL üzeri kargo ücretsizdir.", [1.0, 0.0], model)]),
        ("para", "para", "1.0", "2025-01-01", "active", "politika", "Para İadesi", [("Para İadesi", "Ücret 5 iş gününde kartınıza yatar.", [0.0, 1.0], model)]),
    )


def test_hybrid_search_finds_meaning_without_shared_words(spark):
    index = build_index(hybrid_store(spark), model=MODEL)
    assert index.mode == "hybrid"
    prepared = prepare(index, queries(spark, "geri alırım"), embed=lambda texts: [[0.0, 2.0] for _ in texts])
    result = search(index, prepared, top_k=2)
    hits = with_chunks(index, result.hits).orderBy("rank").collect()
    assert [h.source_id for h in hits] == ["para", "kargo"]
    assert hits[0].dense_score == pytest.approx(1.0) and hits[1].dense_score == 0.0 and hits[0].lexical_score == 0.0
    assert result.stats.first().asDict() == {"query_id": 0, "mode": "hybrid", "max_dense": 1.0, "max_coverage": 0.0}


def test_hybrid_completes_scores_outside_the_pools(spark):
    index = build_index(hybrid_store(spark), model=MODEL)
    options = type(DEFAULTS)(candidate_pool=1)
    prepared = prepare(index, queries(spark, "kargo para"), embed=lambda texts: [[0.6, 0.8] for _ in texts])
    result = search(index, prepared, top_k=5, options=options)
    everything = search(index, prepared, top_k=5)
    assert {(h.doc_no, h.lexical_score, h.coverage, h.dense_score) for h in result.hits.collect()} <= {
        (h.doc_no, h.lexical_score, h.coverage, h.dense_score) for h in everything.hits.collect()
    }


def test_another_models_vectors_are_not_used(spark):
    index = build_index(hybrid_store(spark, model="old-model"), model=MODEL)
    prepared = prepare(index, queries(spark, "kargo ücreti"), embed=lambda texts: [[1.0, 0.0] for _ in texts])
    result = search(index, prepared)
    assert index.mode == "lexical" and result.stats.first()["mode"] == "lexical" and result.hits.count() == 1 + 1


def test_failed_query_embedding_falls_back_to_words(spark):
    index = build_index(hybrid_store(spark), model=MODEL)

    def fails(texts):
        raise ConnectionError("no server")

    result = search(index, prepare(index, queries(spark, "kargo"), embed=fails))
    assert result.stats.first()["mode"] == "lexical"
    assert [h.source_id for h in with_chunks(index, result.hits).collect()] == ["kargo"]

    def fails_for_one(texts):
        if "kargo" in texts[0]:
            raise ConnectionError("no server")
        return [[0.0, 1.0]]

    mixed = search(index, prepare(index, queries(spark, "kargo", "para"), embed=fails_for_one))
    modes = {r.query_id: r.mode for r in mixed.stats.collect()}
    assert modes == {0: "lexical", 1: "hybrid"}
    assert {h.query_id: h.dense_score is None for h in mixed.hits.orderBy("rank").collect()} == {0: True, 1: False}


def test_per_query_limits_and_search_within_documents(spark):
    index = build_index(garden_store(spark))
    asked = spark.createDataFrame([(0, "anahtar parsel", 1), (1, "anahtar parsel", None), (2, "anahtar parsel", 3)], "query_id bigint, text string, top_k int")
    prepared = prepare(index, asked)
    counts = {r.query_id: r["count"] for r in search(index, prepared).hits.groupBy("query_id").count().collect()}
    assert counts == {0: 1, 1: 6, 2: 3}
    numbers = {r.source_id: r.doc_no for r in index.versions.collect()}
    pairs = spark.createDataFrame([(0, numbers["parsel-2025"]), (1, numbers["soru-cevap"])], "query_id bigint, doc_no bigint")
    inside = search_within_documents(index, prepared, pairs, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_no, r.chunk_order) for r in inside] == [
        (0, numbers["parsel-2025"], 0), (0, numbers["parsel-2025"], 1), (1, numbers["soru-cevap"], 0),
    ]


def test_lookups_read_only_the_buckets_they_need(spark):
    index = build_index(garden_store(spark))
    hits = search(index, prepare(index, queries(spark, "kompost torbaları")), top_k=1).hits
    assert index.near(hits, 1).chunks.rdd.getNumPartitions() == 1 < index.chunks.rdd.getNumPartitions()
    everything = with_chunks(index, hits, type(DEFAULTS)(max_pruned_documents=0))
    assert everything.collect() == with_chunks(index, hits).collect()


def test_few_terms_are_pushed_to_the_scan(spark):
    index = build_index(garden_store(spark))
    prepared = prepare(index, queries(spark, "anahtar depozitosu"))
    pruned = of_terms(index.postings, prepared)
    assert "Or(EqualTo(term,anaht),EqualTo(term,depoz))" in pruned._jdf.queryExecution().executedPlan().toString()
    whole = of_terms(index.postings, prepared, type(DEFAULTS)(max_pushed_terms=1))
    score = lambda p: sorted(map(tuple, score_matches(p, prepared.terms, index.average_length, n_terms=prepared.n_terms).collect()))
    assert score(pruned) == score(whole) != []


def test_blocks_of_queries_give_the_same_rows_without_a_shuffle(spark):
    index = build_index(garden_store(spark))
    prepared = prepare(index, queries(spark, *[f"anahtar {w}" for w in ("sulama", "parsel", "kompost", "depozito", "sabah", "torba")]))
    at_once, few = score_matches(index.postings, prepared.terms, index.average_length, n_terms=prepared.n_terms), type(DEFAULTS)(max_broadcast_rows=4)
    blocked = score_matches(index.postings, prepared.terms, index.average_length, n_terms=prepared.n_terms, options=few)
    assert sorted(map(tuple, blocked.collect())) == sorted(map(tuple, at_once.collect()))
    assert exchanges(blocked) == 0


def test_vectors_that_are_not_finite_are_near_to_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, 0, v) for i, v in enumerate([[nan, 1.0], [1.0, 0.0], [inf, 0.0], [0.0, 1.0], [0.6, 0.8]])]
    vectors = spark.createDataFrame(rows, "doc_no bigint, chunk_order int, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "query_id bigint, vector array<float>")
    got = nearest_chunks(vectors, asked, 3).orderBy("rank").collect()
    assert [(r.doc_no, r.dense_score) for r in got] == [(3, 1.0), (4, 0.8), (0, 0.0)]
    pairs = spark.createDataFrame([(0, i) for i in range(5)], "query_id bigint, doc_no bigint")
    assert {r.doc_no: r.dense_score for r in dense_scores(vectors, asked, pairs).collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.8}


def test_a_bucket_stays_small_however_many_documents():
    """What a task sorts and adds up is a bucket, and has to fit in memory."""
    assert bucket_count(100, 8) == 8
    assert 3_000_000 / bucket_count(3_000_000, 12) <= 2_048
