"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of at least ``threshold`` is a distance of at most ``sqrt(2 - 2 threshold)``, so a metric tree
applies. Vectors of one label (and length) are first reduced to different vectors with counts, then dealt out in
blocks of about ``block_rows``: a large label has pivots, each vector goes to the nearest, and a cell that is still
too large is split by a hash. Each block becomes a cover tree: nested levels whose covering radii halve, a node's
first child keeping its centre.

Blocks whose balls are too far apart are never joined. For every other pair of blocks one task walks both trees at
once: a pair of nodes is dropped if their centres are further apart than both radii and the threshold together; if
it lies within the threshold whole, all its vectors are counted as linked without being compared; small nodes are
compared vector by vector. What leaves a task is one row for each linked vector: how many it is linked to in the other
block, and the smallest vector it is connected to there. Pairs are never written.

Cosines are dot products of vectors scaled to length 1 in double precision. Vectors that are null, zero, or hold
null or non-finite components, and rows of a null label, are linked with nothing; rows of a null ``vec_id`` are
linked with nothing either, and have no component (``kept`` is false). Rows of one ``vec_id`` count one by one. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.llm.components import components
from lexifold.sources.scratch import materialize

MARGIN = 1e-9
BLOCKS = "label string, dim int, block string, ids binary, counts binary, vectors binary, tree binary, center array<double>, radius double"


@dataclass(frozen=True)
class CoverOptions:
    """``most_pivots`` bounds what is sent to every task; beyond it cells are larger and split by hash."""

    threshold: float = 0.98
    block_rows: int = 2_048
    most_pivots: int = 4_096
    leaf_rows: int = 32


# --- the tree -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CoverTree:
    """Vectors in the order of the leaves, and nodes: centre (a row), radius, rows ``lo:hi``, children ``first:last``."""

    vectors: np.ndarray
    order: np.ndarray
    nodes: np.ndarray

    FIELDS = np.dtype([("center", "i8"), ("radius", "f8"), ("lo", "i8"), ("hi", "i8"), ("first", "i8"), ("last", "i8")])


def build(vectors: np.ndarray, leaf_rows: int = 32) -> CoverTree:
    """The cover tree of unit vectors."""
    nodes, order, waiting = [], [], []
    # breadth by breadth, so that the children of a node are neighbours; rows are numbered when leaves are known
    root = [np.arange(len(vectors)), 0, 4.0]
    waiting.append(root)
    members: list[np.ndarray] = []
    at = 0
    while at < len(waiting):
        rows, center, scale = waiting[at]
        away = np.sqrt(np.maximum(2 - 2 * vectors[rows] @ vectors[center], 0))
        radius = float(away.max()) if len(rows) > 1 else 0.0
        first = last = 0
        if len(rows) > leaf_rows and radius > MARGIN:
            while scale >= radius:
                scale /= 2
            first = len(waiting)
            rest, chosen = rows, center
            near = away
            while len(rest):
                inside = near <= scale
                inside[rest == chosen] = True
                waiting.append([rest[inside], chosen, scale])
                rest = rest[~inside]
                if len(rest):
                    chosen = rest[0]
                    near = np.sqrt(np.maximum(2 - 2 * vectors[rest] @ vectors[chosen], 0))
            last = len(waiting)
        nodes.append([center, radius + MARGIN if len(rows) > 1 else 0.0, 0, 0, first, last])
        members.append(rows)
        at += 1
    # depth first: the rows of a node are one range
    stack, seen = [(0, False)], 0
    while stack:
        i, done = stack.pop()
        if done:
            nodes[i][3] = seen
            continue
        nodes[i][2] = seen
        stack.append((i, True))
        if nodes[i][4] == nodes[i][5]:
            order.append(members[i])
            seen += len(members[i])
        else:
            stack += [(j, False) for j in range(nodes[i][5] - 1, nodes[i][4] - 1, -1)]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array([(place[c], r, lo, hi, f, l) for c, r, lo, hi, f, l in nodes], CoverTree.FIELDS)
    return CoverTree(np.ascontiguousarray(vectors[order]), order, table)


def linked(a: CoverTree, b: CoverTree | None, threshold: float) -> tuple[list, list]:
    """All links of ``a`` with ``b`` (with itself if None): pairs of row arrays, and pairs of ranges linked as a whole.

    Ranges are (lo, hi) of ``a`` and (lo, hi) of ``b``; every vector of the one is linked with every one of the other
    (in a tree with itself, the ranges are equal or disjoint).
    """
    most = np.sqrt(2 - 2 * threshold)
    other = a if b is None else b
    pairs, ranges = [], []
    stack = [(0, 0)] if len(a.order) and len(other.order) else []
    while stack:
        i, j = stack.pop()
        x, y = a.nodes[i], other.nodes[j]
        same = b is None and i == j
        if x["first"] == x["last"] and y["first"] == y["last"]:
            hit = a.vectors[x["lo"] : x["hi"]] @ other.vectors[y["lo"] : y["hi"]].T >= threshold
            r, c = np.nonzero(np.triu(hit, 1) if same else hit)
            if len(r):
                pairs.append((r + x["lo"], c + y["lo"]))
            continue
        left = np.arange(x["first"], x["last"]) if x["first"] < x["last"] else np.array([i])
        right = np.arange(y["first"], y["last"]) if y["first"] < y["last"] else np.array([j])
        p, q = a.nodes[left], other.nodes[right]
        gap = np.sqrt(np.maximum(2 - 2 * a.vectors[p["center"]] @ other.vectors[q["center"]].T, 0))
        reach = p["radius"][:, None] + q["radius"][None, :]
        near = gap <= reach + most + MARGIN
        if same:
            near &= left[:, None] <= right[None, :]
        whole = near & (gap + reach <= most - MARGIN) & ((p["hi"] - p["lo"])[:, None] * (q["hi"] - q["lo"])[None, :] > 1)
        for r, c in zip(*np.nonzero(whole), strict=True):
            ranges.append((p["lo"][r], p["hi"][r], q["lo"][c], q["hi"][c]))
        for r, c in zip(*np.nonzero(near & ~whole), strict=True):
            stack.append((int(left[r]), int(right[c])))
    return pairs, ranges


def smallest_connected(n: int, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of ``n`` rows the smallest row it is connected to."""
    top = np.arange(n)
    u, v = ends
    while len(u):
        low = np.minimum(top[u], top[v])
        np.minimum.at(top, top[u], low)
        np.minimum.at(top, top[v], low)
        while (top[top] != top).any():
            top = top[top]
        open_ = top[u] != top[v]
        u, v = u[open_], v[open_]
    return top


def tally(a: CoverTree, b: CoverTree | None, counts_a: np.ndarray, counts_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, threshold: float):
    """``(id, linked, smallest)`` of every vector with a link; ids and counts stand in tree order."""
    n = len(a.order)
    m = 0 if b is None else len(b.order)
    pairs, ranges = linked(a, b, threshold)
    ids, counts = np.concatenate((ids_a, ids_b[:m])), np.concatenate((counts_a, counts_b[:m]))
    links, us, vs = np.zeros(n + m, np.int64), [], []
    shift = 0 if b is None else n
    for r, c in pairs:
        c = c + shift
        np.add.at(links, r, counts[c])
        np.add.at(links, c, counts[r])
        us.append(r)
        vs.append(c)
    for lo, hi, lo2, hi2 in ranges:
        lo2, hi2 = lo2 + shift, hi2 + shift
        if (lo, hi) == (lo2, hi2):
            links[lo:hi] += counts[lo:hi].sum() - counts[lo:hi]
        else:
            links[lo:hi] += counts[lo2:hi2].sum()
            links[lo2:hi2] += counts[lo:hi].sum()
        us += [np.arange(lo, hi), np.arange(lo2, hi2)]
        vs += [np.full(hi - lo, lo), np.full(hi2 - lo2, lo)]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # number the rows by id, so that the smallest row is the smallest id
    order = np.argsort(ids)
    place = np.empty(n + m, np.int64)
    place[order] = np.arange(n + m)
    top = smallest_connected(n + m, (place[np.concatenate(us)], place[np.concatenate(vs)]))
    on = np.flatnonzero(links)
    return ids[on], links[on], ids[order][top[place[on]]]


# --- Spark ----------------------------------------------------------------------------------------------------------


def usable(vec_id: Column, label: Column, embedding: Column) -> Column:
    """Whether a row can be linked at all."""
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & embedding.isNotNull() & ~broken & some, F.lit(False))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(pivots: dict):
    """``pivots``: by (label, dim) the unit vectors of the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            units = [_unit([v])[0] for v in rows["embedding"]]
            cell = np.zeros(len(rows), np.int64)
            for key, at in rows.groupby(["label", "dim"]).indices.items():
                centers = pivots.get((key[0], int(key[1])))
                if centers is not None:
                    cell[at] = np.argmax(np.array([units[i] for i in at]) @ centers.T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("dim"), batch.column("rep"), batch.column("n"), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(cell)],
                ["label", "dim", "rep", "n", "unit", "cell"],
            )

    return run


def _pack(leaf_rows: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        x = np.stack([np.frombuffer(u) for u in rows["unit"]])
        tree = build(x, leaf_rows)
        ids, counts = rows["rep"].to_numpy()[tree.order], rows["n"].to_numpy()[tree.order]
        root = tree.nodes[0]
        return pd.DataFrame([{
            "label": key[0], "dim": int(key[1]), "block": f"{key[2]}/{key[3]}", "ids": ids.astype("<i8").tobytes(), "counts": counts.astype("<i8").tobytes(),
            "vectors": tree.vectors.tobytes(), "tree": tree.nodes.tobytes(), "center": tree.vectors[root["center"]].tolist(), "radius": float(root["radius"]),
        }])

    return pack


def _walk(threshold: float):
    names = ("ids", "counts", "vectors", "tree")

    def open_block(row: dict, side: str):
        ids, counts = (np.frombuffer(row[f"{side}_{n}"], "<i8") for n in names[:2])
        vectors = np.frombuffer(row[f"{side}_vectors"]).reshape(len(ids), -1)
        return CoverTree(vectors, np.arange(len(ids)), np.frombuffer(row[f"{side}_tree"], CoverTree.FIELDS)), counts, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a, counts_a, ids_a = open_block(row, "a")
                b, counts_b, ids_b = (None, counts_a, ids_a) if row["a_block"] == row["b_block"] else open_block(row, "b")
                found = tally(a, b, counts_a, counts_b, ids_a, ids_b, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["rep", "linked", "top"])

    return run


def near_duplicates(embeddings: DataFrame, options: CoverOptions = CoverOptions()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (vec_id, embedding, label)."""
    vec_id, embedding = F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    label = F.col("label").cast("string")
    rows = embeddings.select(
        vec_id.alias("vec_id"), F.when(usable(vec_id, label, embedding), F.struct(label.alias("label"), embedding.alias("embedding"))).alias("vector")
    )
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select("vector", "vector.label", F.size("vector.embedding").alias("dim"), F.col("vector.embedding").alias("embedding"), "rep", "n"), "classes")
    # pivots of large labels: a share of their vectors, by hash
    sizes = classes.groupBy("label", "dim").count()
    large = sizes.where(F.col("count") > options.block_rows).select("label", "dim")
    in_large = sizes.where(F.col("count") > options.block_rows).agg(F.sum("count")).first()[0] or 0
    share = min(1 / options.block_rows, options.most_pivots / max(in_large, 1))
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / (1 << 30)
    chosen = classes.where(place < share).join(large, ["label", "dim"], "left_semi").orderBy(place, "rep").limit(options.most_pivots)
    pivots: dict = {}
    for row in chosen.select("label", "dim", "embedding").collect():
        pivots.setdefault((row["label"], row["dim"]), []).append(row["embedding"])
    pivots = {key: _unit(vectors) for key, vectors in pivots.items()}
    cells = classes.select("label", "dim", "rep", "n", "embedding").mapInArrow(
        _cells(pivots), "label string, dim int, rep long, n long, unit binary, cell long"
    )
    cells = materialize(cells, "cells")
    parts = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / options.block_rows).alias("parts"))
    dealt = cells.join(parts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
    blocks = dealt.groupBy("label", "dim", "cell", "part").applyInPandas(_pack(options.leaf_rows), BLOCKS)
    blocks = materialize(blocks, "blocks")
    # which blocks can hold links: their balls come within the threshold of each other
    balls = blocks.select("label", "dim", "block", "center", "radius")
    one = balls.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in ("block", "center", "radius")])
    two = balls.select("label", "dim", *[F.col(c).alias(f"b_{c}") for c in ("block", "center", "radius")])
    squares = F.zip_with("a_center", "b_center", lambda x, y: (x - y) * (x - y))
    gap = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    most = float(np.sqrt(2 - 2 * options.threshold)) + 2 * MARGIN
    pairs = one.join(two, ["label", "dim"]).where("a_block <= b_block").where(gap <= F.col("a_radius") + F.col("b_radius") + most)
    pairs = materialize(pairs.select("label", "dim", "a_block", "b_block"), "pairs")
    for side in ("a", "b"):
        own = blocks.select("label", "dim", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "counts", "vectors", "tree")])
        pairs = pairs.join(own, ["label", "dim", f"{side}_block"])
    found = materialize(pairs.mapInArrow(_walk(options.threshold), "rep long, linked long, top long"), "found")
    tops = materialize(components(found.select(F.col("rep").alias("a"), F.col("top").alias("b"))), "tops")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    named = classes.select("vector", "rep", "n").join(counts, "rep", "left").join(tops.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select(
        "vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    ), "named")
    out = rows.join(named, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
