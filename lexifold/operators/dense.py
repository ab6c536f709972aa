"""Exact nearest chunks by cosine, without materialising query x chunk pairs.

Every chunk has to meet every query once, but only the best few per query may
survive. Each task multiplies its chunk vectors with a block of query vectors
and passes on the best ``pool`` per query; a window then merges the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions.vectors import cosine_similarity, stable
from lexifold.options import DEFAULTS, RetrievalOptions

DENSE_DIGITS = 6
# Keeps the score matrix of a batch small, however many queries there are.
QUERIES_AT_ONCE = 512
RESULT = "query_id {id_type}, doc_no bigint, chunk_order int, dense_score double"


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of the given size as float64 rows; a vector of another size gives a row of zeros."""
    rows = np.zeros((len(vectors), size))
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    values = pc.list_flatten(vectors.filter(fits)).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    rows[places] = values.reshape(len(places), size)
    return rows


def _cosines(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.outer((queries * queries).sum(axis=1), (chunks * chunks).sum(axis=1)))
    dots = queries @ chunks.T
    with np.errstate(invalid="ignore"):
        scores = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    scores[np.isnan(scores)] = 0  # a vector with a number that is not finite is near to nothing
    return np.rint(scores * 10.0**DENSE_DIGITS) / 10.0**DENSE_DIGITS


def _best(scores: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best ``pool`` columns per row; columns are in chunk order, which settles ties."""
    n_columns = scores.shape[1]
    if n_columns <= pool:
        return np.divmod(np.arange(scores.size), n_columns)
    threshold = np.partition(scores, n_columns - pool, axis=1)[:, n_columns - pool]
    rows, columns = [], []
    for row, least in enumerate(threshold):
        above = np.flatnonzero(scores[row] > least)
        equal = np.flatnonzero(scores[row] == least)[: pool - len(above)]
        chosen = np.concatenate([above, equal])
        rows.append(np.full(len(chosen), row))
        columns.append(chosen)
    return np.concatenate(rows), np.concatenate(columns)


def local_best(chunks: pa.Table, queries: pa.Table, pool: int) -> pa.Table:
    """Best chunks of one block of chunks for one block of queries."""
    chunks = chunks.sort_by([("doc_no", "ascending"), ("chunk_order", "ascending")]).combine_chunks()
    sizes = pc.list_value_length(queries["vector"].combine_chunks())
    parts = []
    for size in pc.unique(sizes).to_pylist():
        same_size = queries.filter(pc.equal(sizes, size))
        # A chunk vector of another length is a row of zeros, whose similarity is 0.
        rows_of_size = matrix(chunks["embedding"].combine_chunks(), size)
        for start in range(0, same_size.num_rows, QUERIES_AT_ONCE):
            asked = same_size.slice(start, QUERIES_AT_ONCE).combine_chunks()
            scores = _cosines(matrix(asked["vector"].combine_chunks(), size), rows_of_size)
            rows, columns = _best(scores, pool)
            parts.append(
                pa.table(
                    {
                        "query_id": asked["query_id"].take(pa.array(rows)),
                        "doc_no": chunks["doc_no"].take(pa.array(columns)),
                        "chunk_order": chunks["chunk_order"].take(pa.array(columns)),
                        "dense_score": scores[rows, columns],
                    }
                )
            )
    return pa.concat_tables(parts)


def _with_broadcast_queries(vectors: DataFrame, queries: DataFrame, pool: int, schema: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries.select("query_id", "vector").toArrow())

    def best_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and shared.value.num_rows:
                yield from local_best(pa.Table.from_batches([batch]), shared.value, pool).combine_chunks().to_batches()

    return vectors.mapInArrow(best_of_batches, schema)


def nearest_chunks(
    vectors: DataFrame, queries: DataFrame, pool: int, options: RetrievalOptions = DEFAULTS
) -> DataFrame:
    """``doc_no, chunk_order, embedding`` x ``query_id, vector`` -> the best ``pool`` chunks of every query, ranked."""
    queries = queries.where(F.col("vector").isNotNull())
    vectors = vectors.select("doc_no", "chunk_order", "embedding")
    schema = RESULT.format(id_type=queries.schema["query_id"].dataType.simpleString())
    values = queries.agg(F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0))).first()[0]
    # Too many queries to send at once go in blocks; each meets the vectors where they lie, so vectors are never shuffled.
    blocks = max(1, -(-values // options.max_broadcast_values))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_with_broadcast_queries(vectors, queries.where(block == n), pool, schema) for n in range(blocks)]
    local = reduce(DataFrame.unionByName, parts)
    return best_of_all(local, pool)


def best_of_all(found: DataFrame, pool: int) -> DataFrame:
    """The best ``pool`` of what the tasks passed on, ranked; document numbers settle ties."""
    window = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "doc_no", "chunk_order")
    return (
        found.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= pool)
        .select("query_id", "rank", "doc_no", "chunk_order", "dense_score")
    )


def dense_scores(vectors: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cosine of the given ``query_id, doc_no[, chunk_order]`` pairs only."""
    on = [c for c in ("doc_no", "chunk_order") if c in candidates.columns]
    near = vectors.select("doc_no", "chunk_order", "embedding").join(candidates, on)
    return near.join(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), "query_id").select(
        "query_id",
        "doc_no",
        "chunk_order",
        stable(cosine_similarity(F.col("embedding"), F.col("vector")), DENSE_DIGITS).alias("dense_score"),
    )
