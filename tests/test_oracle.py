"""A few queries against their SQL at the smallest size; ``python -m workload.compare`` runs them all."""

import os

import pytest

import __spark_entry__ as entry
from workload.compare import compare
from workload.oracle import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
CHECKED = ("s4_validation", "t2_tokens", "c4_chunk_order", "a4_bm25", "w1_lexical_topk", "l4_search_hybrid", "l7_context", "j12_conflicts")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    same, message = compare(spark, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert same, message
