"""Batch search: many queries against one index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions.text import query_embedding_text, tokens
from lexifold.operators.bm25 import (
    CHUNK,
    LexicalPool,
    distinct_query_terms,
    pool_by_blocks,
    pool_by_matrices,
    score_candidates,
    weigh_query_terms,
)
from lexifold.operators.cells import VectorCells, nearest_in_cells
from lexifold.operators.dense import dense_scores, nearest_chunks
from lexifold.operators.fusion import DENSE_LIST, LEXICAL_LIST, fuse
from lexifold.operators.models import EmbedFn, embed_texts
from lexifold.operators.validation import validate_queries
from lexifold.options import DEFAULTS, EmbeddingOptions, RetrievalOptions
from lexifold.plans.index import HYBRID, LEXICAL, KnowledgeIndex
from lexifold.sources.scratch import broadcast_if_small, materialize


@dataclass(frozen=True)
class PreparedQueries:
    """``queries``: ``query_id, text, terms, vector`` and, if given, ``top_k``; ``terms``: weighted distinct terms."""

    queries: DataFrame
    terms: DataFrame
    n_terms: int
    with_vectors: bool


@dataclass(frozen=True)
class SearchResult:
    """``hits``: ranked chunks per query with their scores; ``stats``: mode and best scores per query; ``lexical``: the word pool."""

    hits: DataFrame
    stats: DataFrame
    lexical: LexicalPool


def prepare(
    index: KnowledgeIndex,
    queries: DataFrame,
    embed: EmbedFn | None = None,
    embedding: EmbeddingOptions | None = None,
) -> PreparedQueries:
    """Terms and vector of each query, computed once for all searches of the batch.

    ``queries``: ``query_id, text[, top_k][, vector]``. Vectors come along with
    the queries or from ``embed``; a query whose embedding fails is searched by
    words alone. Without usable chunk vectors no query is embedded.
    """
    base = queries.withColumn("terms", tokens(F.col("text")))
    hybrid = index.mode == HYBRID
    if hybrid and "vector" not in queries.columns and embed is not None:
        settings = embedding or EmbeddingOptions(model=index.embedding_model)
        base = embed_texts(
            base.withColumn("embed_text", query_embedding_text(F.col("text"), settings.query_prefix)),
            embed, settings.batch_size, retry_single=True,
        ).drop("embed_text", "embed_error")
    elif not hybrid or "vector" not in queries.columns:
        base = base.drop("vector").withColumn("vector", F.lit(None).cast("array<float>"))
    base = materialize(base, "prepared")
    terms = materialize(
        weigh_query_terms(distinct_query_terms(base), index.terms, index.n_chunks), "query-terms"
    )
    return PreparedQueries(base, terms, terms.count(), hybrid and not base.where(F.col("vector").isNotNull()).isEmpty())


def within(postings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Postings of the allowed chunks. Joined on the bucketing key alone, so two bucketed tables meet without a shuffle."""
    orders = allowed.groupBy("doc_no").agg(F.collect_set("chunk_order").alias("allowed_orders"))
    return (
        postings.join(orders, "doc_no")
        .where(F.array_contains("allowed_orders", F.col("chunk_order")))
        .drop("allowed_orders")
    )


def of_terms(postings: DataFrame, prepared: PreparedQueries, options: RetrievalOptions = DEFAULTS) -> DataFrame:
    """Postings or block maxima of the terms asked for: few terms are named in the filter, and the scan skips the pages of all others.

    The terms are compared one by one, as a long ``IN`` list is pushed down only as a range.
    """
    if prepared.n_terms > options.max_pushed_terms:
        return postings
    terms = [row["term"] for row in prepared.terms.select("term").distinct().collect()]
    return postings.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in sorted(terms)], F.lit(False)))


def _complete(
    fused: DataFrame, known: DataFrame, score_missing, columns: tuple[str, ...], n_rows: int, options: RetrievalOptions
) -> DataFrame:
    """Scores of the fused hits (``n_rows`` of them): from their own pool, else computed for just those pairs."""
    joined = fused.join(known, ["query_id", *CHUNK], "left")
    missing = joined.where(F.col(columns[0]).isNull()).select("query_id", *CHUNK)
    late = score_missing(broadcast_if_small(missing, n_rows, options.max_broadcast_rows)).select("query_id", *CHUNK, *[F.col(c).alias(f"late_{c}") for c in columns])
    return joined.join(late, ["query_id", *CHUNK], "left").select(
        *fused.columns, *[F.coalesce(c, f"late_{c}").alias(c) for c in columns]
    )


def search(
    index: KnowledgeIndex,
    prepared: PreparedQueries,
    top_k: int | None = None,
    where: Column | None = None,
    options: RetrievalOptions = DEFAULTS,
    cells: VectorCells | None = None,
) -> SearchResult:
    """BM25 pool and vector pool per query, fused by reciprocal rank.

    ``top_k``: one limit for all, or None for the queries' own ``top_k`` column
    (the default where absent). ``where``: predicate on chunk columns; it
    restricts the chunks scored but not the corpus statistics. ``cells``: the
    index's vectors by cell (``build_cells(index.vectors)``), of which only those
    that matter are read; with ``where``, all allowed vectors are compared.
    """
    postings, vectors = index.postings, index.vectors
    if where is not None:
        allowed = index.chunks.where(where)
        postings, vectors = within(postings, allowed), allowed.select(*CHUNK, "embedding")

    if prepared.n_terms > options.max_bounded_terms:
        found = pool_by_matrices(
            postings, prepared.terms, index.average_length, n_terms=prepared.n_terms, pool=options.candidate_pool, options=options
        )
    else:
        found = pool_by_blocks(
            of_terms(postings, prepared, options), of_terms(index.blocks, prepared, options), prepared.terms, index.average_length,
            n_terms=prepared.n_terms, pool=options.candidate_pool, options=options,
        )
    lexical, coverage = found.ranked, found.coverage

    lists = lexical.select("query_id", F.lit(LEXICAL_LIST).alias("list_no"), "rank", *CHUNK)
    dense = None
    if prepared.with_vectors:
        if cells is None or where is not None:
            nearest = nearest_chunks(vectors, prepared.queries, options.candidate_pool, options)
        elif cells.n.sum() != index.n_chunks:
            raise ValueError(f"cells of {cells.n.sum()} vectors for an index of {index.n_chunks}: build them anew")
        else:
            nearest = nearest_in_cells(cells, prepared.queries, options.candidate_pool, options).ranked
        dense = materialize(nearest, "dense-pool")
        lists = lists.unionByName(dense.select("query_id", F.lit(DENSE_LIST).alias("list_no"), "rank", *CHUNK))

    fused = fuse(lists, CHUNK, options.rrf_k)
    if top_k is not None:
        fused = fused.where(F.col("rank") <= top_k)
    elif "top_k" in prepared.queries.columns:
        fused = (
            fused.join(prepared.queries.select("query_id", "top_k"), "query_id")
            .where(F.col("rank") <= F.coalesce("top_k", F.lit(options.top_k)))
            .drop("top_k")
        )
    else:
        fused = fused.where(F.col("rank") <= options.top_k)

    lexical_scores = lexical.select("query_id", *CHUNK, "score", "coverage")
    if dense is None:
        hits = fused.join(lexical_scores, ["query_id", *CHUNK]).withColumn("dense_score", F.lit(None).cast("double"))
    else:
        fused = materialize(fused, "fused")
        n_fused = fused.count()
        near = index.near(fused, n_fused, options)
        hits = _complete(
            fused,
            lexical_scores,
            lambda pairs: score_candidates(near.postings, prepared.terms, pairs, index.average_length, options),
            ("score", "coverage"),
            n_fused,
            options,
        )
        hits = _complete(
            hits,
            dense.select("query_id", *CHUNK, "dense_score"),
            lambda pairs: dense_scores(near.vectors, prepared.queries, pairs),
            ("dense_score",),
            n_fused,
            options,
        )
    hits = hits.select(
        "query_id", "rank", *CHUNK, "fused_score",
        F.coalesce("score", F.lit(0.0)).alias("lexical_score"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        "dense_score",
    )

    stats = prepared.queries.select("query_id", "vector").join(coverage, "query_id", "left")
    if dense is None:
        stats = stats.withColumn("max_dense", F.lit(0.0))
    else:
        best = dense.where(F.col("rank") == 1).select("query_id", F.col("dense_score").alias("max_dense"))
        stats = stats.join(best, "query_id", "left")
    mode = F.when(F.lit(dense is not None) & F.col("vector").isNotNull(), HYBRID).otherwise(LEXICAL)
    stats = stats.select(
        "query_id",
        mode.alias("mode"),
        F.coalesce("max_dense", F.lit(0.0)).alias("max_dense"),
        F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"),
    )
    return SearchResult(hits, stats, found)


def search_requests(
    index: KnowledgeIndex | None,
    requests: DataFrame,
    embed: EmbedFn | None = None,
    embedding: EmbeddingOptions | None = None,
    where: Column | None = None,
    options: RetrievalOptions = DEFAULTS,
) -> tuple[DataFrame, SearchResult | None]:
    """Checks, then searches: ``requests`` (``query_id, text, top_k[, vector]``) -> answers per request, and the hits.

    The first has ``query_id, text, top_k, status, message_code`` of every
    request: 400 for a blank or too long text or a ``top_k`` out of range, 503
    without an index. Only requests with status 200 are searched.
    """
    checked = materialize(validate_queries(require_unique(requests), index is not None, options), "requests")
    if index is None:
        return checked, None
    valid = checked.where(F.col("status") == 200).select("query_id", "text", "top_k")
    if "vector" in requests.columns:
        valid = valid.join(requests.select("query_id", "vector"), "query_id")
    return checked, search(index, prepare(index, valid, embed, embedding), where=where, options=options)


def require_unique(queries: DataFrame) -> DataFrame:
    """``queries`` if no ``query_id`` is repeated or missing; otherwise their hits would be mixed up."""
    repeated = queries.groupBy("query_id").count().where((F.col("count") > 1) | F.col("query_id").isNull())
    count, first = repeated.agg(F.count(F.lit(1)), F.min("query_id")).first()
    if count:
        raise ValueError(f"query_id has to be unique: {count} values are not, {first} among them")
    return queries


def search_within_documents(
    index: KnowledgeIndex,
    prepared: PreparedQueries,
    documents: DataFrame,
    limit: int,
    options: RetrievalOptions = DEFAULTS,
    n_documents: int | None = None,
) -> DataFrame:
    """``query_id, doc_no`` -> the best ``limit`` chunks of each pair, ranked as a search of that document alone.

    ``n_documents``: an upper bound of the pairs, where one is known.
    """
    if n_documents is not None:
        index = index.near(documents, n_documents, options)
        documents = broadcast_if_small(documents, n_documents, options.max_broadcast_rows)
    per = ("query_id", "doc_no")
    window = Window.partitionBy(*per)

    def pool(scored: DataFrame, score: str, list_no: int) -> DataFrame:
        order = window.orderBy(F.desc(score), "chunk_order")
        return (
            scored.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= options.candidate_pool)
            .select(*per, F.lit(list_no).alias("list_no"), "rank", "chunk_order")
        )

    scored = score_candidates(index.postings, prepared.terms, documents, index.average_length, options)
    lists = pool(scored, "score", LEXICAL_LIST)
    if prepared.with_vectors:
        lists = lists.unionByName(pool(dense_scores(index.vectors, prepared.queries, documents), "dense_score", DENSE_LIST))
    return fuse(lists, ("chunk_order",), options.rrf_k, per).where(F.col("rank") <= limit)


def with_chunks(index: KnowledgeIndex, hits: DataFrame, options: RetrievalOptions = DEFAULTS) -> DataFrame:
    """Hits, counted first, with the chunk they point at."""
    hits = materialize(hits, "hits")
    n_hits = hits.count()
    chunks = index.near(hits, n_hits, options).chunks.drop("embedding", "embedding_model")
    return broadcast_if_small(hits, n_hits, options.max_broadcast_rows).join(chunks, list(CHUNK))
