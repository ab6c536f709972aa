"""Exact nearest chunks that reads only some of the vectors.

Vectors lie in *cells* around centres, each with its radius: the widest angle
between a member and its centre. By the triangle inequality no member is nearer
to a query than the angle to the centre less the radius. A first pass scores
the cells nearest to each query until ``pool`` vectors are met, which gives the
query a floor; a second pass scores the cells whose bound reaches it. Cells that
nobody opens are not read. The result equals ``nearest_chunks`` on all vectors,
whatever the centres are; bad centres cost time only.

Vectors that have no direction (null, zero, not finite) or another size than
most lie in a cell of their own (``ODD``), where similarity is 0 for queries of
the usual size. Queries of another size, or without a direction, open all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators.dense import QUERIES_AT_ONCE, RESULT, best_of_all, local_best, matrix
from lexifold.options import DEFAULTS, RetrievalOptions
from lexifold.sources.scratch import materialize, new_folder

ODD = -1
MEMBERS = "cell int, angle double, doc_no bigint, chunk_order int, embedding array<float>"
BOUNDS = "cell int, radius double, n bigint"
# Scores are rounded to six digits, and angles near 0 are known to about 1e-8.
MARGIN = 2e-6


@dataclass(frozen=True)
class CellOptions:
    """Centres are fitted on at most ``sample`` vectors, and on at most ``sample_values`` components; every vector gets a cell."""

    cells: int | None = None  # by default the root of the number of vectors, at most max_cells
    max_cells: int = 1_024
    sample: int = 20_000
    sample_values: int = 8_000_000
    rounds: int = 6


@dataclass(frozen=True)
class VectorCells:
    """``centres``: unit vectors of the cells 0, 1, ...; ``radius`` and ``n`` alike, and those of ``ODD`` last."""

    members: DataFrame | None
    centres: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]


@dataclass(frozen=True)
class CellSearch:
    """``ranked`` as from ``nearest_chunks``; ``opened``: ``query_id, n_cells, n_vectors`` scored for each query."""

    ranked: DataFrame
    opened: DataFrame


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; rows of zeros where there is no direction."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    unit[~np.isfinite(unit).all(axis=1)] = 0
    return unit


def fit_centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means; each centre starts at the row farthest from those before it, which keeps the radii small."""
    unit = _directions(sample)
    unit = unit[unit.any(axis=1)]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    starts, nearest = [0], unit @ unit[0]
    while len(starts) < cells and nearest.min() < 1 - MARGIN:
        starts.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[starts[-1]])
    centres = unit[starts]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved = _directions(sums)
        centres = np.where(moved.any(axis=1, keepdims=True), moved, centres)
    return centres


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _directions(matrix(batch.column("embedding"), centres.shape[1]))
            cell, angle = np.full(len(unit), ODD), np.zeros(len(unit))
            regular = unit.any(axis=1)
            if len(centres) and regular.any():
                cosines = unit[regular] @ centres.T
                cell[regular] = cosines.argmax(axis=1)
                angle[regular] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            arrays = [pa.array(cell, pa.int32()), pa.array(angle), *[batch.column(c) for c in ("doc_no", "chunk_order", "embedding")]]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "angle", "doc_no", "chunk_order", "embedding"])

    return run


def build_cells(vectors: DataFrame, path: str | None = None, options: CellOptions = CellOptions()) -> VectorCells:
    """Write ``doc_no, chunk_order, embedding``, a folder for each cell. A big cell has many files, so no cell is one task's work."""
    spark = vectors.sparkSession
    path = path or new_folder(spark, "cells")
    vectors = vectors.select("doc_no", "chunk_order", "embedding")
    sizes = vectors.groupBy(F.size("embedding").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
    cells = options.cells or min(options.max_cells, int(np.ceil(np.sqrt(n))))

    # The rows of the smallest hashes: a sample that does not depend on where rows lie, of bounded size.
    rows = min(options.sample, options.sample_values // max(1, size))
    sample = vectors.where(F.size("embedding") == size).orderBy(F.xxhash64("doc_no", "chunk_order")).limit(rows).select("embedding").toArrow()
    centres = fit_centres(matrix(sample["embedding"].combine_chunks(), size), cells, options.rounds)

    assigned = vectors.mapInArrow(_assign(centres), MEMBERS)
    spread = assigned.repartitionByRange("cell", F.xxhash64("doc_no", "chunk_order")).sortWithinPartitions("cell")
    spread.write.partitionBy("cell").parquet(f"{path}/members")
    members = spark.read.schema(MEMBERS).parquet(f"{path}/members")
    members.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/bounds")
    spark.createDataFrame([(centres.tobytes(), size)], "centres binary, size int").write.parquet(f"{path}/centres")
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> VectorCells:
    kept = spark.read.schema("centres binary, size int").parquet(f"{path}/centres").first()
    centres = np.frombuffer(bytes(kept["centres"])).reshape(-1, kept["size"]) if kept["size"] else np.zeros((0, 0))
    radius, n = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for row in spark.read.schema(BOUNDS).parquet(f"{path}/bounds").collect():  # a row for each cell
        radius[row["cell"]], n[row["cell"]] = row["radius"], row["n"]  # ODD is the last
    return VectorCells(spark.read.schema(MEMBERS).parquet(f"{path}/members"), centres, radius, n)


def _bounds(cells: VectorCells, vectors: pa.Array) -> np.ndarray:
    """The greatest similarity a member of each cell can have with each query; empty cells have none."""
    usual = pc.fill_null(pc.equal(pc.list_value_length(vectors), cells.size), False).to_numpy(zero_copy_only=False)
    unit = _directions(matrix(vectors, cells.size))
    angles = np.arccos(np.clip(unit @ cells.centres.T, -1, 1))
    bounds = np.zeros((len(unit), len(cells.n)))
    bounds[:, :-1] = np.cos(np.maximum(0, angles - cells.radius[:-1]))
    bounds[~(usual & unit.any(axis=1))] = 1
    bounds[:, cells.n == 0] = -np.inf
    return bounds + MARGIN


def _open_first(cells: VectorCells, pool: int):
    """Adds ``cells``: those of the greatest bounds, up to the one that completes the pool."""

    def choose(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
        order = np.argsort(-bounds, axis=1, kind="stable")
        members = cells.n[order]
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, np.cumsum(members, axis=1) - members < pool, axis=1)
        return chosen

    return _opener(cells, choose)


def _open_later(cells: VectorCells):
    """The cells that can reach ``floor`` in place of those that were opened before."""

    def choose(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
        chosen = bounds >= batch.column("floor").to_numpy(zero_copy_only=False)[:, None]
        before = batch.column("cells")
        chosen[pc.list_parent_indices(before).to_numpy(), pc.list_flatten(before).to_numpy()] = False
        return chosen

    return _opener(cells, choose)


def _opener(cells: VectorCells, choose):
    numbers = np.append(np.arange(len(cells.centres)), ODD).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES_AT_ONCE):
                batch = pa.Table.from_batches([whole.slice(start, QUERIES_AT_ONCE)]).combine_chunks().to_batches()[0]
                chosen = choose(batch, _bounds(cells, batch.column("vector"))) & (cells.n > 0)
                lists = pa.array([numbers[row] for row in chosen], pa.list_(pa.int32()))
                sums = pa.array((chosen * cells.n).sum(axis=1), pa.int64())
                arrays = [batch.column("query_id"), batch.column("vector"), lists, sums]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vector", "cells", "n_vectors"])

    return run


def _score(members: DataFrame, asked: DataFrame, pool: int, schema: str) -> DataFrame:
    """The best of the opened cells; ``asked`` is one block of queries with their cells."""
    opened = [row[0] for row in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most all cells
    members = members.where(F.col("cell").isin(opened) if opened else F.lit(False)).select("cell", "doc_no", "chunk_order", "embedding")
    shared = members.sparkSession.sparkContext.broadcast(asked.select("query_id", "vector", "cells").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value.combine_chunks()
        lists = queries["cells"].combine_chunks()
        flat, owners = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        by_cell = np.argsort(flat, kind="stable")
        flat, owners, queries = flat[by_cell], owners[by_cell], queries.drop_columns("cells")
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            numbers = batch.column("cell").to_numpy()
            for cell in np.unique(numbers):
                low, high = np.searchsorted(flat, [cell, cell + 1])
                if low < high:
                    some = rows.filter(pa.array(numbers == cell)).drop_columns("cell")
                    yield from local_best(some, queries.take(pa.array(owners[low:high])), pool).combine_chunks().to_batches()

    return members.mapInArrow(run, schema)


def _in_blocks(members: DataFrame, asked: DataFrame, pool: int, schema: str, options: RetrievalOptions) -> DataFrame:
    """Queries in blocks of bounded size: their vectors and the numbers of their cells."""
    values = asked.agg(F.coalesce(F.sum((F.size("vector") + F.size("cells")).cast("bigint")), F.lit(0))).first()[0]
    blocks = max(1, -(-values // options.max_broadcast_values))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = _score(members, asked.where(block == 0), pool, schema)
    for number in range(1, blocks):
        found = found.unionByName(_score(members, asked.where(block == number), pool, schema))
    return found


def nearest_in_cells(cells: VectorCells, queries: DataFrame, pool: int, options: RetrievalOptions = DEFAULTS) -> CellSearch:
    """``query_id, vector`` -> the best ``pool`` chunks of every query, ranked as by ``nearest_chunks`` over all vectors."""
    queries = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    id_type, vector_type = (queries.schema[c].dataType.simpleString() for c in ("query_id", "vector"))
    schema = RESULT.format(id_type=id_type)
    opened = f"query_id {id_type}, vector {vector_type}, cells array<int>, n_vectors bigint"

    plain = replace(cells, members=None)  # a table cannot travel with the job
    leading = materialize(queries.mapInArrow(_open_first(plain, pool), opened), "leading-cells")
    first = materialize(best_of_all(_in_blocks(cells.members, leading, pool, schema, options), pool), "first-pass")
    floors = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == pool, F.col("dense_score"))).alias("floor"))
    floors = floors.select("query_id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    asked = leading.join(floors, "query_id").drop("n_vectors")
    later = materialize(asked.mapInArrow(_open_later(plain), opened).where(F.size("cells") > 0), "later-cells")
    second = _in_blocks(cells.members, later, pool, schema, options)
    ranked = best_of_all(first.drop("rank").unionByName(second), pool)
    both = leading.unionByName(later).groupBy("query_id")
    return CellSearch(ranked, both.agg(F.sum(F.size("cells")).alias("n_cells"), F.sum("n_vectors").alias("n_vectors")))
