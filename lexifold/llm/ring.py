"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` virtual nodes on a ring of 64-bit hashes; the *arc* before a point is home to the keys that
hash into it. A shard takes no more rows than its capacity: rows that find it full continue clockwise to the next point
of a shard with room. Rows move in waves: first every arc offers all its rows at its own point, then what was left
over is offered at the next open point, and so on; within a wave, points are served in ring order, and the last rows of
an arc (by a hash of their key) are the first to continue. So a row is away from home only if its shard was full.

With ``slack`` 0 the capacities add up to the number of rows, so counts of shards differ by one at most. With a slack
of 0.25 a shard holds up to a quarter more than the mean, and another shard moves little besides what it receives.

Where a row goes follows from its place in the order of (arc, hash of its key) and the counts of the arcs. The order
is one range shuffle, in which rows of one key are told apart and split, so a key with a third of all rows is no
burden; placing the arcs is arithmetic on ``shards * points`` counts.

Defined results: rows of a null key have one home like those of any other key; repeated rows each get a slot of their
own; ties of key hashes are settled by a hash of the whole row (columns of a map type left out), and rows equal in that
too stand in any order; an empty table gives an empty one. Input columns are returned in the struct ``row``, so none clashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lexifold.sources.scratch import materialize

# Bits of monotonically_increasing_id below the partition number.
INDEX_BITS = 33


@dataclass(frozen=True)
class Ring:
    shards: int = 8
    points: int = 128
    slack: float = 0.0
    seed: int = 42

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions of all points, and the shard of each; a shard's points do not depend on the others."""
        import xxhash

        at = [
            (xxhash.xxh64_intdigest(f"{shard}/{point}", self.seed), shard)
            for shard in range(self.shards)
            for point in range(self.points)
        ]
        at.sort()
        return np.array([a for a, _ in at], np.uint64), np.array([s for _, s in at], np.int64)

    def capacities(self, rows: int) -> list[int]:
        """How many of ``rows`` each shard may hold; together at least all of them."""
        if self.slack > 0:
            return [int(-(-rows * (1 + self.slack) // self.shards))] * self.shards
        return [rows // self.shards + (shard < rows % self.shards) for shard in range(self.shards)]


def share_out(counts: Sequence[int], owners: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int, int]]:
    """``(arc, shard, rows)`` in ring order: how the rows of each arc are divided, in their order, among shards.

    ``counts[a]`` rows start at point ``a``, which belongs to shard ``owners[a]``.
    """
    n, free = len(counts), list(capacities)
    onward = list(range(n))  # towards the next point of a shard that may have room

    def open_point(point: int) -> int:
        path = []
        while free[owners[point]] == 0 or onward[point] != point:
            path.append(point)
            if onward[point] == point:
                onward[point] = (point + 1) % n
            point = onward[point]
        for p in path:
            onward[p] = point
        return point

    parts: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    waiting = [(arc, arc, int(count)) for arc, count in enumerate(counts) if count]
    while waiting:
        # Rows met by a full shard wait for the next wave; the order of points within a wave is that of the ring.
        wave = sorted((point, (point - arc) % n, arc, count) for arc, point, count in waiting)
        waiting = []
        for point, _, arc, count in wave:
            shard = owners[point]
            taken = min(count, free[shard])
            if taken:
                free[shard] -= taken
                parts[arc].append((arc, shard, taken))
            if count > taken:
                waiting.append((arc, point, count - taken))
        waiting = [(arc, open_point(point), count) for arc, point, count in waiting]
    return [part for arc in parts for part in arc]


def place(rows: DataFrame, key: str, ring: Ring = Ring()) -> DataFrame:
    """``row, shard, slot``: every row of ``rows`` (as a struct) with its shard and its gapless number there from 0."""
    positions, owners = ring.nodes()

    @F.pandas_udf("int")
    def arc_of(hashes: pd.Series) -> pd.Series:
        found = np.searchsorted(positions, hashes.to_numpy(np.int64).view(np.uint64))
        return pd.Series((found % len(positions)).astype(np.int32))

    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    hashable = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    hashed = rows.select(
        whole.alias("row"), F.xxhash64(F.lit(ring.seed), F.col(f"`{key}`")).alias("at"), F.xxhash64(*hashable).alias("tie")
    )
    # Rows alike in everything are told apart by where they were read, so that ranges can split them.
    homes = hashed.select("row", arc_of("at").alias("arc"), F.xxhash64("at").alias("at"), "tie", F.monotonically_increasing_id().alias("copy"))
    order = ("arc", "at", "tie", "copy")
    ranged = homes.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.select("row", "arc", F.monotonically_increasing_id().alias("number")), "ring")

    part = F.shiftrightunsigned("number", INDEX_BITS).cast("int")
    sizes = numbered.groupBy(part.alias("part"), "arc").agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes, "ring-sizes")  # at most one row for each arc and each partition, as both ascend together
    in_parts = {r["part"]: r["rows"] for r in sizes.groupBy("part").agg(F.sum("rows").alias("rows")).collect()}
    in_arcs = {r["arc"]: r["rows"] for r in sizes.groupBy("arc").agg(F.sum("rows").alias("rows")).collect()}

    before = np.zeros(max(in_parts, default=0) + 2, np.int64)
    for number, count in in_parts.items():
        before[number + 1] = count
    before = np.cumsum(before)
    parts = share_out([in_arcs.get(a, 0) for a in range(len(owners))], owners.tolist(), ring.capacities(int(before[-1])))
    starts = np.cumsum([0, *[n for _, _, n in parts]])[:-1].astype(np.int64)
    shards, slots, filled = np.array([s for _, s, _ in parts], np.int32), [], [0] * ring.shards
    for _, shard, count in parts:
        slots.append(filled[shard])
        filled[shard] += count
    first_slots = np.array(slots, np.int64)

    @F.pandas_udf("shard int, slot long")
    def where(numbers: pd.Series) -> pd.DataFrame:
        number = numbers.to_numpy(np.int64)
        at = before[number >> INDEX_BITS] + (number & ((1 << INDEX_BITS) - 1))
        piece = np.searchsorted(starts, at, side="right") - 1
        return pd.DataFrame({"shard": shards[piece], "slot": first_slots[piece] + at - starts[piece]})

    return numbered.select("row", where("number").alias("place")).select("row", "place.shard", "place.slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder ``shard=N`` for each shard; its files hold the rows by ascending slot."""
    ranged = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)
