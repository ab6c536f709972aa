import math

import numpy as np
import pytest
from lexifold.llm import whitening
from lexifold.llm.queries import QUERIES, white_components

SF = "/root/testdata/sf0.01"


def plain(rows):
    """What the query returns, from the matrix of covariances itself."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    far = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    centred = np.array([[f / n for f in r] for r in far])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, [sum(f * f for f in r) for r in far], centred, values[::-1], vectors[:, ::-1]


def compare(out, rows, components=32, digits=1e-7):
    kept, n, deviations, centred, values, vectors = plain(rows)
    got = sorted((r["vec_id"], r["component"], r) for r in out)
    ids = [i for i, _ in kept]
    wanted = min(components, int((values > 1e-12 * values[0]).sum()))
    assert [(i, k) for i, k, _ in got] == sorted((i, k) for i in ids for k in range(1, wanted + 1))
    white = np.zeros((len(ids), wanted))
    for i, k, r in got:
        at = ids.index(i)
        assert (r["n"], r["deviation"]) == (n, deviations[at])
        assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        white[at, k - 1] = r["whitened"]
    expected = centred @ vectors[:, :wanted] / np.sqrt(values[:wanted])
    signs = np.sign((expected * white).sum(axis=0))
    assert np.abs(expected * signs - white).max() < digits


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = QUERIES["op12_chebyshev_whitening"](spark, SF)
    assert dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    compare(out.collect(), rows)


def test_nulls_odd_entries_repeats_and_names(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(float).tolist()) for i in range(40)]
    odd = [
        (100, None), (101, []), (102, [None] * 6), (103, [math.nan, *[0.0] * 5]), (104, [math.inf, *[0.0] * 5]),
        (105, [0.0] * 5), (106, [1e30, *[0.0] * 5]),
    ]
    more = [(200, [0.0] * 6), (201, [-0.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows + odd + more], "vec_id long, embedding array<double>, key string, n int, grid double")
    white = whitening.fit(df.repartition(3))
    assert white.n == 43 and white.passes == 1
    got = whitening.transform(white).collect()
    assert sorted(r["key"] for r in got) == sorted([*range(40), 200, 201, 0])
    assert all(len(r["whitened"]) == 6 for r in got)
    again = [r["whitened"] for r in got if r["key"] == 0]
    assert again[0] == again[1]
    none = whitening.fit(df.limit(0))
    assert none.n == 0 and whitening.transform(none).collect() == [] and whitening.identity_error(none) == 0
    assert white_components(df.limit(0)).collect() == []
    assert white_components(df.where("vec_id = 3")).collect() == []


def test_fewer_directions_than_wanted(spark):
    rng = np.random.default_rng(6)
    basis = rng.integers(-9, 9, (3, 60))
    rows = [(i, (rng.integers(-50, 50, 3) @ basis).astype(float).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(white_components(df).collect(), rows)


def test_passes_find_the_leading_pairs_of_any_spectrum():
    rng = np.random.default_rng(7)
    for spectrum in (np.linspace(1, 2, 200), 0.9 ** np.arange(200), np.r_[np.ones(100), np.full(100, 1.02)], np.r_[[1e6], rng.random(199)], 1 + rng.random(200) / 100):
        turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
        matrix = (turn * spectrum) @ turn.T
        options = whitening.WhiteningOptions(components=20, guard=20)
        values, vectors, residuals = whitening.leading_pairs(lambda q: matrix @ q, 200, spectrum.sum(), options)
        assert values == pytest.approx(np.sort(spectrum)[::-1][:20], abs=1e-12 * values[0])
        assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12
        assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1.1e-12 * values[0]
    with pytest.raises(ArithmeticError):
        whitening.leading_pairs(lambda q: matrix @ q, 200, spectrum.sum(), whitening.WhiteningOptions(components=20, guard=1, rounds=1))


def test_deviations_beyond_a_long(spark):
    rows = [(1, [2.0**24] * 4), (2, [-(2.0**24)] * 4), (3, [0.5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["key"]: r["deviation"] for r in whitening.transform(whitening.fit(df)).collect()}
    _, _, expected, *_ = plain(rows)
    assert got == {i: d if d < 2**63 else None for (i, _), d in zip(rows, expected, strict=True)}
