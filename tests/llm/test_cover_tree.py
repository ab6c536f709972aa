import numpy as np
import pytest
from lexifold.llm import cover_tree as ct


def plain(rows, threshold=0.98):
    def ok(i, v, label):
        return i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [k for k, (i, v, label) in enumerate(rows) if ok(i, v, label)]
    top = {k: k for k in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    top[find(b)] = find(a)
    smallest = {}
    for k in good:
        smallest[find(k)] = min(smallest.get(find(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = smallest[find(k)] if k in good else i
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def clouds(seed, n, dim=8, spread=0.08):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [(centers[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, spread, 3.0])).tolist() for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_tree_and_traversal(leaf):
    x, y = ct._unit(clouds(1, 300)), ct._unit(clouds(1, 450)[100:])
    a, b = ct.build(x, leaf), ct.build(y, leaf)
    for tree in (a, b):
        assert sorted(tree.order.tolist()) == list(range(len(tree.order)))
        for node in tree.nodes:
            gap = np.sqrt(np.maximum(2 - 2 * tree.vectors[node["lo"] : node["hi"]] @ tree.vectors[node["center"]], 0))
            assert gap.max() <= node["radius"] + 1e-7 and node["lo"] <= node["center"] < node["hi"]
            children = tree.nodes[node["first"] : node["last"]]
            assert len(children) == 0 or (children["radius"].max() <= node["radius"] and children[0]["center"] == node["center"])
    for other in (None, b):
        pairs, ranges = ct.linked(a, other, 0.98)
        found = {(int(r), int(c)) for rs, cs in pairs for r, c in zip(rs, cs, strict=True)}
        n = sum(len(r) for r, _ in pairs)
        for lo, hi, lo2, hi2 in ranges:
            more = {(r, c) for r in range(lo, hi) for c in range(lo2, hi2) if (lo, hi) != (lo2, hi2) or r < c}
            found |= more
            n += len(more)
        assert n == len(found)  # no link twice
        hit = a.vectors @ (a if other is None else b).vectors.T >= 0.98
        if other is None:
            found = {tuple(sorted(p)) for p in found}
            hit = np.triu(hit, 1)
        assert found == set(zip(*(v.tolist() for v in np.nonzero(hit)), strict=True))


@pytest.mark.parametrize("options", [ct.CoverOptions(), ct.CoverOptions(block_rows=16, most_pivots=5, leaf_rows=4), ct.CoverOptions(block_rows=7, leaf_rows=1)])
def test_rows_against_brute_force(spark, options):
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, i % 2) for i, v in enumerate(clouds(2, 160))]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)]  # exact copies
    rows += [(2000, [2 * x for x in rows[5][1]], 1), (2001, rows[5][1], None), (2002, None, 1), (2003, [0.0] * 8, 1), (2004, [nan] * 8, 1), (2005, [1.0, inf], 1)]
    rows += [(2006, [1.0, None], 1), (2007, [], 1), (2008, [1.0, 0.0], 1), (2009, [1e300, 0.0], 1), (2010, [1e-300, -0.0], 1), (None, rows[5][1], 1), (5, rows[5][1], 1)]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep int, component string").repartition(4)
    got = sorted((tuple(r) for r in ct.near_duplicates(frame, options).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    assert ct.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
