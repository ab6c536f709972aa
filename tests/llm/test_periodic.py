import hashlib
import random
import re
import zlib

import pytest
from lexifold.llm import periodic
from lexifold.llm.queries import QUERIES, cyclic_runs

SF = "/root/testdata/sf0.01"


def plain_runs(words, exponent=4, least=6):
    """Runs by comparing every text with itself at every distance."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else None
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 1), (3, 7), (5, 20)])
def test_runs_of_small_alphabets(exponent, least):
    rng = random.Random(exponent)
    texts = []
    for _ in range(400):
        words = rng.choices("abcdef"[: rng.choice((1, 2, 3, 6))], k=rng.randrange(60))
        for _ in range(rng.randrange(4)):
            at, block = rng.randrange(len(words) + 1), rng.choices("abc", k=rng.randrange(1, 7))
            words[at:at] = (block * 9)[: rng.randrange(1, 9 * len(block))]
        texts.append([w.encode() for w in words])
    options = periodic.RunOptions(exponent, least)
    found = periodic.find_runs(texts, options)
    assert sum(map(len, found)) > 150
    assert found == [plain_runs(t, exponent, least) for t in texts]
    assert [periodic.find_runs([t], options)[0] for t in texts[:50]] == found[:50]
    fibonacci, before = "ab", "a"
    while len(fibonacci) < 3000:
        fibonacci, before = fibonacci + before, fibonacci
    letters = [c.encode() for c in fibonacci]
    assert periodic.find_runs([letters], options)[0] == plain_runs(letters, exponent, least)
    with pytest.raises(ValueError):
        periodic.RunOptions(2)


def test_many_left_words_and_long_texts():
    rng = random.Random(3)
    lines = [w for i in range(4000) for w in (b"n%d" % i, b"the", b"same", b"five", b"words", b"here")]
    one = [b"a"] * 30_000
    block = [b"w%d" % rng.randrange(50) for _ in range(700)]
    long = [b"x", *block * 40, b"y"]
    found = periodic.find_runs([lines, one, long, []])
    assert found[0] == [] and found[1] == [(0, 30_000, 1)] and found[3] == []
    assert (1, 28_000, 700) in found[2]


def test_rows(spark):
    cycle = "a b c " * 9
    rows = [(1, cycle, 5, "k"), (1, cycle, 6, "k"), (None, cycle, 7, None), (2, None, 8, "r"), (3, "", 9, "n"), (4, " \t\n", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, runs string").repartition(3)
    got = sorted(map(tuple, periodic.periodic_runs(df).collect()), key=str)
    run = (27, [(0, 27, 3)], "a b c")
    assert got == sorted([(1, *run), (1, *run), (None, *run), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], "")], key=str)
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    odd = [(i, t) for i, t in enumerate(["é é " * 8, "a\x1ca " * 7, "\x85 \x85 " * 6, "A a " * 9, "q" * 70_000, None, "", "z " * 40_000])]
    odd = [(seed * 8 + i, t) for seed in range(12) for i, t in odd]
    out = cyclic_runs(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: plain(i, t) for i, t in odd if t is None or len(t) < 70_000} | {i: got[i] for i, t in odd if t and len(t) >= 70_000}
    assert all(got[i][0] == 1 and got[i][2] == 40_000 for i, t in odd if t and t.startswith("z"))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op13_maximal_pairs"](spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert set(got) == set(docs)
    short = {i: t for i, t in docs.items() if len(t or "") < 12_000}
    assert len(short) > 0.95 * len(docs)
    assert {i: got[i] for i in short} == {i: plain(i, t) for i, t in short.items()}
    assert sum(g[0] > 0 for g in got.values()) > 30
