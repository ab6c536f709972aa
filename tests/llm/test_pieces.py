from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lexifold.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "\n", "a", "the", " the  quick\n\n brown", "▁ mark ▁▁", "é ß 日本語 🙂 \x00\t\x7f", "word " * 3000, "x" * 5000, " " * 300 + "y",
    "tail \n", "hello world " * 3, "𝔘𝔫𝔦" * 40, "<s></s><unk><0x41>",
]


@pytest.fixture(scope="module")
def lattice():
    return pieces.PieceLattice(FILE)


def segmentations(lattice, text):
    """All segmentations with their weights, by plain recursion."""
    if not text:
        return [((), 1.0)]
    out = []
    single = text[0] in lattice.arcs
    for k in range(1, len(text) + 1):
        if text[:k] in lattice.arcs:
            i, w = lattice.arcs[text[:k]]
            out += [((i, *rest), w * v) for rest, v in segmentations(lattice, text[k:])]
    if not single:
        ids = tuple(lattice.bytes_at[b] for b in text[0].encode())
        out += [(ids + rest, lattice.byte_weight ** len(ids) * v) for rest, v in segmentations(lattice, text[1:])]
    return out


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", "k", 1)] * 2, "doc_id long, text string, ids string, _other int")
    coded = pieces.encode(docs, FILE, keep=("text",))
    rows = pieces.decode(coded, FILE, keep=("text", "ids")).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["decoded"] == (r["text"] or "") for r in rows)
    twice = [r["ids"] for r in rows if r["doc_id"] is None]
    assert twice[0] == twice[1]
    # the same samples however the rows are spread
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(7), FILE).collect()}
    assert other == {r["doc_id"]: r["ids"] for r in rows}
    assert pieces.encode(docs.limit(0), FILE).count() == 0
    changed = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, FILE, pieces.SampleOptions(seed=5)).collect()}
    assert changed[10] != other[10]


@pytest.mark.parametrize("text", [" the", "hello", " ation", "é🙂", "\n", " x▁"])
def test_samples_follow_the_lattice(lattice, text):
    every = segmentations(lattice, text)
    total = sum(w for _, w in every)
    n = 6000
    got = Counter(tuple(x.tolist()) for x in lattice.encode([text] * n, [str(i) for i in range(n)]))
    assert set(got) <= {ids for ids, _ in every}
    for ids, w in every:
        share = w / total
        assert abs(got[ids] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 2e-4


def test_a_row_is_sampled_alike_beside_any_other(lattice):
    """Texts of many characters without a piece, four bytes each, weigh less than a double holds."""
    rng = np.random.default_rng(2)
    faint = ["".join(chr(0x10000 + int(c)) for c in rng.integers(0, 0x8000, n)) for n in (16, 17, 20, 32, 33, 90)]
    texts = [t or "" for t in TEXTS] + faint + [f + " and words" for f in faint] + ["plain " + f for f in faint]
    keys = [str(i % 7) for i in range(len(texts))]
    together = [x.tolist() for x in lattice.encode(texts, keys)]
    alone = [lattice.encode([t], [k])[0].tolist() for t, k in zip(texts, keys, strict=True)]
    behind = [x.tolist() for x in lattice.encode(texts[::-1] + faint * 3, keys[::-1] + ["k"] * (3 * len(faint)))][: len(texts)]
    assert together == alone == behind[::-1]
    lists = pa.array(together, pa.list_(pa.int32()))
    assert lattice.decode_lists(lists).to_pylist() == texts
    assert lattice.decode_lists(lists.slice(3, 5)).to_pylist() == texts[3:8]


@pytest.mark.parametrize("n", [17, 20])
def test_shares_of_stretches_that_weigh_almost_nothing(lattice, n):
    text = "".join(chr(0x20000 + 37 * i) for i in range(n)) + "the"
    tail, draws = segmentations(lattice, "the"), 4000
    total = sum(w for _, w in tail)
    got = Counter(tuple(x.tolist()[4 * n :]) for x in lattice.encode([text] * draws, [str(i) for i in range(draws)]))
    assert len(got) > 1 and set(got) <= {ids for ids, _ in tail}
    for ids, w in tail:
        share = w / total
        assert abs(got[ids] / draws - share) < 5 * np.sqrt(share * (1 - share) / draws) + 3e-4


def test_long_stretches_agree_with_short_ones(lattice, monkeypatch):
    texts = [t or "" for t in TEXTS] + [" internationalization of words", "a" * 31]
    keys = [str(i) for i in range(len(texts))]
    arrays = [x.tolist() for x in lattice.encode(texts, keys)]
    monkeypatch.setattr(pieces, "SHORT", 0)
    single = [x.tolist() for x in lattice.encode(texts, keys)]
    assert arrays == single
    monkeypatch.setattr(pieces, "CHARS", 50)
    assert [x.tolist() for x in lattice.encode(texts, keys)] == single


def plain_sample(lattice, text, key):
    """A text's sample, stretch by stretch and place by place, with exact shares."""
    import re
    from fractions import Fraction

    import xxhash

    start, out = np.uint64(xxhash.xxh64_intdigest(key.encode(), 23)), []
    for number, stretch in enumerate(re.findall(r"\n| *[^ \n]+| +", text)):
        into, ways = [[] for _ in range(len(stretch) + 1)], [Fraction(1)] + [Fraction(0)] * len(stretch)
        for at in range(len(stretch)):
            steps = [(end, *lattice.arcs[stretch[at:end]]) for end in range(at + 1, len(stretch) + 1) if stretch[at:end] in lattice.arcs]
            steps = [(end, (i,), Fraction(w)) for end, i, w in steps]
            if not any(end == at + 1 for end, *_ in steps):
                octets = stretch[at].encode()
                steps.append((at + 1, tuple(lattice.bytes_at[b] for b in octets), Fraction(lattice.byte_weight) ** len(octets)))
            for end, ids, weight in steps:
                into[end].append((at, ids, ways[at] * weight))
                ways[end] += ways[at] * weight
        at, step, back = len(stretch), 0, []
        while at:
            goal, upto = float(pieces.draws(np.array([start]), np.array([number]), step)[0]), Fraction(0)
            for before, ids, weight in into[at]:
                upto += weight / ways[at]
                if goal < upto:
                    break
            back.append(ids)
            at, step = before, step + 1
        out += [i for ids in reversed(back) for i in ids]
    return out


def test_query(spark, lattice):
    import zlib

    from lexifold.llm.queries import op8_sampled_pieces

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op8_sampled_pieces(spark, sf).collect()}
    assert set(got) == set(docs) and all(r["lossless"] for r in got.values())
    short = {i: t for i, t in docs.items() if len(t) < 3000}
    assert len(short) > 0.7 * len(docs)
    for i, text in short.items():
        ids = plain_sample(lattice, text, str(i))
        assert (got[i]["n_pieces"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(",".join(map(str, ids)).encode()))
