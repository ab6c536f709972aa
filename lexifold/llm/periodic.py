"""Periodic runs of words, from the maximal pairs of the LCP-interval tree.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. A maximal pair is a
stretch of words at two places ``i < j`` that are preceded by different words and followed by different words. If its
length is at least ``(exponent - 1) * (j - i)``, the words from ``i`` to the end of the second place are a stretch of
period ``j - i`` that cannot be extended, so the pair *is* a run: nothing has to be compared or extended afterwards. Of
pairs that span the same stretch the one of least distance has the smallest period.

The pairs come from a bottom-up walk over the LCP-interval tree of each text. A node stands for the words that all
suffixes below it share, ``l`` of them, and holds their places. Its children are united, the smaller into the larger;
places of different children are followed by different words, and those with different words before them, the left
classes, form maximal pairs. Only distances up to ``l / (exponent - 1)`` count, which bounds the search around a place.
With an exponent of three or more, places so near to each other are equally far apart, and all but the first of them
have the same word before them; so of the class lists within reach only the first place has to be looked at.

Texts are numbered, sorted by prefix doubling and measured (LCP by the ranks of each doubling) many at a time in numpy;
texts in which no stretch of the least length occurs twice never come so far. Work is ``O(n log n)`` sorting steps for
a text of n words, memory about ``8 * log n`` bytes a word of a group of texts; no text is cut.

Defined results: null text counts as empty and has no words and no runs; null keys, repeated rows and ties are kept, row
by row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
# Words of the texts that are sorted together; a longer text is a group of its own.
GROUP_WORDS = 300_000


@dataclass(frozen=True)
class RunOptions:
    """A run has at least ``exponent`` periods (3 or more) and ``least`` words."""

    exponent: int = 4
    least: int = 6

    def __post_init__(self) -> None:
        if self.exponent < 3 or self.least < 1:
            raise ValueError("the exponent of a run has to be 3 or more, its least length 1 or more")

    @property
    def shared(self) -> int:
        """The least length of a maximal pair that is a run, over all distances."""
        k = self.exponent
        return min(max(self.least - q, (k - 1) * q) for q in range(1, max(2, self.least + 1)))


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, texts one after the other, and where each starts.

    Each text has numbers of its own, and one more after its last word, so nothing is shared between texts.
    """
    parts, starts, used = [], [0], 0
    for words in texts:
        index = {w: n for n, w in enumerate(dict.fromkeys(words), used)}
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        used += len(index)
        parts.append(np.array([used]))
        used += 1
        starts.append(starts[-1] + len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts[:-1], np.int64)


def with_repeats(numbers: np.ndarray, starts: np.ndarray, shared: int) -> np.ndarray:
    """Texts (their places in ``starts``) that may have a stretch of ``shared`` words twice; by hash, so none is missed."""
    n = len(numbers) - shared + 1
    if n < 2:
        return np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shared):
            hashes = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (numbers[k : k + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(hashes)
    ascending = hashes[order]
    again = order[1:][ascending[1:] == ascending[:-1]]
    return np.unique(np.searchsorted(starts, again, side="right") - 1)


def suffix_order(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and how many words each shares with the next where that is ``least`` or more, else 0.

    Ranks after 1, 2, 4, ... words; only suffixes whose rank is not their own yet are sorted again. Equal ranks of a
    doubling mean as many equal words, so shared words are counted from the largest doubling down.
    """
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], numbers[order][1:] != numbers[order][:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    doublings, width = [rank.astype(np.int32)], 1
    alone = np.repeat(np.diff(np.append(first, n)) == 1, np.diff(np.append(first, n)))
    active = order[~alone]
    while len(active):
        keys = rank[active] * n + rank[active + width]
        by = np.argsort(keys, kind="stable")
        active, keys = active[by], keys[by]
        old = rank[active]
        new_group = np.concatenate(([True], keys[1:] != keys[:-1]))
        old_group = np.concatenate(([True], old[1:] != old[:-1]))
        places = np.arange(len(active))
        sub = np.maximum.accumulate(np.where(new_group, places, 0))
        rank[active] = old + sub - np.maximum.accumulate(np.where(old_group, places, 0))
        width *= 2
        doublings.append(rank.astype(np.int32))
        alone = new_group & np.append(new_group[1:], True)
        active = active[~alone]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    shares = np.zeros(max(n - 1, 0), np.int64)
    level = max(least, 1).bit_length() - 1
    if n > 1 and level < len(doublings):
        at = doublings[level][suffixes]
        near = np.flatnonzero(at[1:] == at[:-1])
        a, b = suffixes[near], suffixes[near + 1]
        length = np.zeros(len(near), np.int64)
        for k in range(len(doublings) - 1, -1, -1):
            equal = doublings[k][a + length] == doublings[k][b + length]
            length[equal] += 1 << k
        shares[near] = np.where(length >= least, length, 0)
    return suffixes, shares


def _unite(one: list[int], other: list[int], shared: int, reach: int, left: list[int] | np.ndarray, found: dict) -> list[int]:
    """The places of two children as one ascending list; what they form with each other goes to ``found``."""
    big, small = (one, other) if len(one) >= len(other) else (other, one)
    for place in small:
        at = bisect_left(big, place - reach)
        if at < len(big) and big[at] < place and left[big[at]] != left[place]:
            _note(found, big[at], place, shared)
        at = bisect_right(big, place, at)
        if at < len(big) and big[at] <= place + reach and left[big[at]] != left[place]:
            for later in big[at : bisect_right(big, place + reach, at)]:
                _note(found, place, later, shared)
    if len(small) == 1:
        big.insert(bisect_left(big, small[0]), small[0])
        return big
    return sorted(big + small)


def _note(found: dict, first: int, second: int, shared: int) -> None:
    period = second - first
    stretch = (first, shared + period)
    if period < found.get(stretch, period + 1):
        found[stretch] = period


def maximal_pairs(suffixes: list[int], shares: list[int], left: np.ndarray, options: RunOptions, found: dict) -> None:
    """Runs of one subtree: ``shares[k]`` words are shared by suffixes k and k + 1. ``found``: (start, length) -> period."""
    nodes: list[tuple[int, list[int]]] = []
    carried = [suffixes[0]]
    part = options.exponent - 1
    for suffix, shared in zip(suffixes[1:], shares, strict=True):
        while nodes and nodes[-1][0] > shared:
            depth, places = nodes.pop()
            carried = _unite(places, carried, depth, depth // part, left, found)
        if nodes and nodes[-1][0] == shared:
            carried = _unite(nodes.pop()[1], carried, shared, shared // part, left, found)
        nodes.append((shared, carried))
        carried = [suffix]
    while nodes:
        depth, places = nodes.pop()
        carried = _unite(places, carried, depth, depth // part, left, found)


def find_runs(texts: list[list[bytes]], options: RunOptions = RunOptions()) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each text (a list of words), by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = options.shared
    some = with_repeats(*number_words(texts), least) if texts else []
    if not len(some):
        return runs
    numbers, starts = number_words([texts[i] for i in some])
    suffixes, shares = suffix_order(numbers, least)
    left = np.concatenate(([-1], numbers[:-1])).tolist()  # before a text is the number after the last one
    # Subtrees: suffixes next to each other that share enough, each with its first and last place.
    deep = shares > 0
    edges = np.diff(np.concatenate(([0], deep.astype(np.int8), [0])))
    found: dict[tuple[int, int], int] = {}
    for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        places = suffixes[begin : end + 1]
        gap = int(np.diff(np.sort(places)).min())
        if gap * (options.exponent - 1) <= int(shares[begin:end].max()):
            maximal_pairs(places.tolist(), shares[begin:end].tolist(), left, options, found)
    of = np.searchsorted(starts, [start for start, _ in found], side="right") - 1 if found else []
    for ((start, length), period), text in zip(found.items(), of, strict=True):
        if length >= options.least:
            runs[some[text]].append((start - int(starts[text]), length, period))
    for text in some:
        runs[text].sort(key=lambda r: (r[0], r[2]))
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def _finder(key: str, options: RunOptions):
    def result(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts, options)
        as_rows = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
        kept = [b" ".join(collapse(words, found)) for words, found in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(t) for t in texts], pa.int64()), pa.array(as_rows, pa.list_(RUN)), pa.array(kept, pa.binary())],
            [key, "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts, begin, size = batch.column("text"), [], 0, 0
            for at in range(batch.num_rows):
                words = (column[at].as_py() or b"").split()
                texts.append(words)
                size += len(words)
                if size >= GROUP_WORDS or at + 1 == batch.num_rows:
                    yield result(batch.column(key).slice(begin, len(texts)), texts)
                    texts, begin, size = [], at + 1, 0

    return run


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", options: RunOptions = RunOptions()) -> DataFrame:
    """``<key>, n_words, runs, collapsed`` of every row: its runs, and its words without their repetitions, joined by spaces.

    Words are what stands between ASCII blanks (space, tab to carriage return).
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("text"))
    of_key = rows.schema["key"].dataType.simpleString()
    schema = f"key {of_key}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = rows.mapInArrow(_finder("key", options), schema)
    return found.select(F.col("key").alias(key), "n_words", "runs", F.decode("collapsed", "UTF-8").alias("collapsed"))
