import random

import numpy as np
from lexifold.llm import golay
from lexifold.llm.components import components


def smallest_reachable(nodes, linked):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = {i: plain_fingerprint(t or "") for i, t in rows}
    ids = sorted(fps)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(fps[a] ^ fps[b]).count("1") <= 2]
    top = smallest_reachable(ids, near)
    return {i: (f"{fps[i]:016x}", top[i]) for i in ids}


def test_code_is_perfect_and_keys_meet():
    patterns = golay.error_patterns()
    assert len(np.unique(patterns)) == 2048 and max(bin(p).count("1") for p in patterns) == 3
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    nearest = words ^ patterns[golay.syndrome(words)]
    assert (golay.syndrome(nearest) == 0).all()
    for distance in (0, 1, 2):
        other = words.copy()
        for row in range(len(other)):
            for bit in rng.choice(23, distance, replace=False):
                other[row] ^= 1 << int(bit)
        for one, two in zip(golay.segment_keys(words), golay.segment_keys(other), strict=True):
            assert np.intersect1d(one, two).size and len(one) in (1, 6)
    direct = [np.unique(golay.codeword_index(w ^ np.concatenate(([0], 1 << np.arange(23))))) for w in words[:200]]
    assert all((a == b).all() for a, b in zip(direct, golay.segment_keys(words[:200]), strict=True))


def test_links_connect_what_two_bits_connect(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):  # one dense cloud, chains, strays
        center = rng.getrandbits(64)
        for _ in range(120):
            fps.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
        for _ in range(20):
            center ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(center)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bits(a, b) <= 2]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {n: c for n, c in smallest_reachable(signed, near).items() if any(n in p for p in near)}
    for most in (0, 8, 64, 10_000):
        found = golay.links(table, most)
        assert all(bits(a, b) <= 2 for a, b in found.collect())
        assert {r[0]: r[1] for r in components(found).collect()} == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = list(range(500))
    rng.shuffle(chain)
    linked = list(zip(chain, chain[1:], strict=False)) + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    nodes = {n for p in linked for n in p}
    assert got == smallest_reachable(nodes, linked)
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"word{i % 83}" for i in range(400))
    rows = [(10, base), (3, base + " tail"), (7, base.upper()), (20, None), (21, ""), (22, " \n\t"), (30, "One"), (31, "ONE"), (32, "one two"),
            (40, "É é"), (41, "é É"), (50, "x" * 200_000), (60, "a b c d e f " * 3000)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, fp int, component string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in golay.near_duplicates(docs).collect()}
    assert got == expected(rows)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "q r s")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in golay.near_duplicates(twice).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert golay.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from lexifold.llm.queries import op5_simhash

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: (r[1], r[2]) for r in op5_simhash(spark, sf).collect()} == expected(rows)
