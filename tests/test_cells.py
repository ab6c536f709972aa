"""Nearest chunks by cell equal those over all vectors, and far cells stay closed."""

import numpy as np
import pytest

from lexifold.operators.cells import ODD, CellOptions, build_cells, load_cells, nearest_in_cells
from lexifold.operators.dense import nearest_chunks
from lexifold.options import DEFAULTS

VECTORS = "doc_no bigint, chunk_order int, embedding array<float>"
QUERIES = "query_id bigint, vector array<float>"


def clustered(spark, groups=12, each=40, size=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, size))
    rows = (np.repeat(centres, each, axis=0) + 0.05 * rng.normal(size=(groups * each, size))).astype("float32")
    rows[5:35] = rows[5]  # copies, so ties decide
    odd = [None, [0.0] * size, [float("nan")] * size, [1.0, 2.0], []]
    table = [(i // 4, i % 4, v) for i, v in enumerate([*rows.tolist(), *odd])]
    asked = [(i, (centres[i % groups] + 0.05 * rng.normal(size=size)).astype("float32").tolist()) for i in range(20)]
    asked.append((20, rows[5].tolist()))
    return spark.createDataFrame(table, VECTORS).repartition(6), asked


def ranked(found):
    return sorted((r.query_id, r["rank"], r.doc_no, r.chunk_order, r.dense_score) for r in found.collect())


@pytest.mark.parametrize("limit", [16_000_000, 150])
def test_equals_all_vectors(spark, limit):
    vectors, asked = clustered(spark)
    asked += [(30, [-1.0] * 16), (31, [0.0] * 16), (32, [2.0, 1.0]), (33, None), (34, [float("inf")] * 16)]
    asked = spark.createDataFrame(asked, QUERIES)
    options = type(DEFAULTS)(max_broadcast_values=limit)
    cells = build_cells(vectors, options=CellOptions(cells=12))
    assert cells.n.sum() == 12 * 40 + 5 and cells.n[ODD] == 5
    found = nearest_in_cells(cells, asked, 20, options)
    assert ranked(found.ranked) == ranked(nearest_chunks(vectors, asked, 20))
    opened = {r.query_id: r for r in found.opened.collect()}
    assert max(opened[q].n_vectors for q in range(21)) < 4 * 40
    assert opened[32].n_vectors == opened[31].n_vectors == 485  # no direction to go by: all cells
    plan = cells.members.where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan  # other cells are not read


def test_no_structure_few_vectors_and_empty(spark):
    rng = np.random.default_rng(8)
    asked = spark.createDataFrame([(i, rng.normal(size=6).astype("float32").tolist()) for i in range(5)], QUERIES)
    loose = spark.createDataFrame([(i, 0, rng.normal(size=6).astype("float32").tolist()) for i in range(70)], VECTORS)
    cells = build_cells(loose, options=CellOptions(sample=10))
    again = load_cells(spark, cells.members.inputFiles()[0].split("/members/")[0])
    assert ranked(nearest_in_cells(again, asked, 9).ranked) == ranked(nearest_chunks(loose, asked, 9))
    few = loose.where("doc_no < 3")
    assert ranked(nearest_in_cells(build_cells(few), asked, 9).ranked) == ranked(nearest_chunks(few, asked, 9))
    none = loose.where("doc_no < 0")
    assert nearest_in_cells(build_cells(none), asked, 9).ranked.collect() == []
    assert nearest_in_cells(cells, asked.limit(0), 9).ranked.collect() == []
