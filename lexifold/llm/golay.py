"""Near-duplicate fingerprints found through the binary Golay code.

The (23, 12) Golay code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A fingerprint of
64 bits is cut into segments of 23, 23 and 18 bits (the last filled with zeros). A segment's *keys* are the
codewords of the word itself and of its 23 neighbours at one bit: 1 or 6 different ones. Two words at 2 or fewer
bits have a common neighbour (or are neighbours), hence a common key.

Two fingerprints at 2 or fewer bits differ, by the pigeonhole principle, in no bit of at least one segment, and in
at most 2 bits of the next one. So they share one of the buckets (segment number, that segment, a key of the next
segment): at most 18 buckets a fingerprint.

Equal fingerprints are one class before anything is joined. Buckets with few members are joined and verified by
counting bits. Where a bucket has more than ``most_joined`` members, all pairs would grow with its square: its
members instead meet in *midpoints*. Two fingerprints are at 2 or fewer bits exactly if some word is at one bit or
less from both; each member emits its 65 such words, and all that meet in a word are linked to the smallest. That is
exact too, and no word has more than 65 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.llm.components import components
from lexifold.sources.scratch import materialize

# The generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and its length.
GENERATOR = 0b101011100011
LENGTH = 23
SEED = 42


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, A-Z lower-cased; 0 if it has no word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_per_shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.array([fingerprint(t or b"", words_per_shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, words_per_shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) of ``documents`` (doc_id, text); null text counts as empty."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(_fingerprints(words_per_shingle, seed), "doc_id long, fp long")


# --- the code -------------------------------------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial: equal for words that differ by a codeword."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def error_patterns() -> np.ndarray:
    """The pattern of 3 or fewer bits behind each of the 2048 syndromes."""
    bits = 1 << np.arange(LENGTH)
    one = np.concatenate(([0], bits))
    patterns = np.unique(one[:, None, None] | one[None, :, None] | one[None, None, :])
    found = np.zeros(2048, np.int64)
    found[syndrome(patterns)] = patterns
    return found


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword nearest to each 23-bit word: its leading 12 bits, as the code is systematic."""
    return (words ^ error_patterns()[syndrome(words)]) >> 11


@cache
def _segment_keys() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the difference of a word's key words to the word itself (24 columns), so that keys need no decoding."""
    flips = np.concatenate(([0], 1 << np.arange(LENGTH)))
    words = error_patterns()  # one word of each syndrome
    return flips, (flips[None, :] ^ error_patterns()[syndrome(words[:, None] ^ flips[None, :])])


def segment_keys(words: np.ndarray) -> list[np.ndarray]:
    """The different codeword indices within one bit of each word."""
    _, moves = _segment_keys()
    return [np.unique(row) for row in (words[:, None] ^ moves[syndrome(words)]) >> 11]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    """Three segments of unsigned fingerprints: bits 0-22, 23-45, 46-63."""
    mask = np.uint64((1 << LENGTH) - 1)
    return [((fps >> np.uint64(LENGTH * i)) & mask).astype(np.int64) for i in range(3)]


def buckets(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (index of the fingerprint, bucket): segment number, segment and a key of the next segment in one number."""
    parts = segments(fps)
    rows, keys = [], []
    for i in range(3):
        near = segment_keys(parts[(i + 1) % 3])
        count = np.fromiter(map(len, near), np.int64, len(near))
        rows.append(np.repeat(np.arange(len(fps)), count))
        exact = np.repeat((i << LENGTH) | parts[i], count)
        keys.append((exact << 12) | (np.concatenate(near) if len(near) else np.zeros(0, np.int64)))
    return np.concatenate(rows), np.concatenate(keys)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column("fp")[at : at + 4096].to_numpy(zero_copy_only=False)
            rows, keys = buckets(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["bucket", "fp"])


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, most_joined: int = 64) -> DataFrame:
    """Links ``a, b`` between different values of ``fp`` that connect exactly what 2 or fewer differing bits connect."""
    keyed = materialize(fps.mapInArrow(_buckets, "bucket long, fp long"), "buckets")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(keyed.join(sizes, "bucket"), "shared")
    few = shared.where(F.col("members") <= most_joined).select("bucket", "fp")
    pairs = few.select("bucket", F.col("fp").alias("a")).join(few.select("bucket", F.col("fp").alias("b")), "bucket")
    near = pairs.where((F.col("a") < F.col("b")) & (differing_bits(F.col("a"), F.col("b")) <= 2)).select("a", "b")
    many = shared.where(F.col("members") > most_joined).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = many.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    met = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.union(star).distinct()


def near_duplicates(documents: DataFrame, words_per_shingle: int = 3, seed: int = SEED, most_joined: int = 64) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``documents`` (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints at 2 or fewer bits. Null text counts as
    empty; texts without a word have fingerprint 0 and are linked like any other; rows of a null ``doc_id`` link
    like others but give no name (null if all of a component are null); repeated rows all stay; an empty table
    gives an empty table; other columns are ignored.
    """
    marked = materialize(fingerprints(documents, words_per_shingle, seed), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = materialize(components(links(classes.select("fp"), most_joined)), "components")
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = materialize(named.join(smallest, "component").select("fp", "component_id"), "names")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
