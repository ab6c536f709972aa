import zlib

import numpy as np
import pytest
from lexifold.llm import planes

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(FILE), [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_of_a_block(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint32)
    for n in (0, 1, 7, 8, 1003):
        assert (planes.join_planes(planes.shuffle_planes(ids[:n], kind), n) == ids[:n]).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_hold_what_the_tokenizer_gives(spark, tmp_path, kind):
    texts = [
        "It's a TEST'S don't 'llama 12345 #a,b..c <|endoftext|> x<|startoftext|>y", None, "", " \t\n", "İstanbul ſ K ǅ Σίσυφος ΣΑΣ",
        "éa ́b", "tab\x00nul \x7f\x1f", "日本語 🙂‍↔️ a b c\u0085d", "word " * 5000, "'s'S 'Re ''ll", "ﬀ½Ⅷ٣",
    ]
    rows = list(enumerate(texts)) + [(100, "twice"), (100, "twice")]
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in reversed(rows)], "doc_id long, text string, start int, shard int").repartition(5)
    path = str(tmp_path / "ids")
    planes.write_ids(docs, path, FILE, 2, planes.PlaneFormat(block_ids=64, planes=kind))
    want = expected(rows)
    assert sorted(tuple(r) for r in planes.read_checksums(spark, path).collect()) == sorted(w[:4] for w in want)
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in planes.read_ids(spark, path).collect()) == sorted((*w[:3], w[4]) for w in want)
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert [r["start"] for r in index] == list(np.cumsum([0] + [r["n_ids"] for r in index[:-1]]))
    assert all(r["n_ids"] <= 64 and len(r["planes"]) == (4 if kind == "byte" else 32) for r in index)


def test_no_character_of_a_word_is_skipped():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(FILE), planes.WordTokenizer(FILE)
    blanks = [chr(c) for c in (*range(0x20), 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF)]
    for text in ["a\x1cb", "b\x1f", "\x1d", *blanks, *(f"a{c}b" for c in blanks), *(f"{c}'s{c}{c}7" for c in blanks)]:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_null_ids_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, None), (5, "b")], "doc_id long, text string")
    planes.write_ids(docs, str(tmp_path / "a"), FILE, 2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in planes.read_checksums(spark, str(tmp_path / "a")).collect())
    assert [g[1] for g in got] == [None, None, 5] and sum(g[2] for g in got) == 5
    planes.write_ids(docs.limit(0), str(tmp_path / "b"), FILE, 2)
    assert planes.read_checksums(spark, str(tmp_path / "b")).count() == 0


def test_query_on_whole_documents(spark):
    from lexifold.llm.queries import op2_bit_planes

    sf = "/root/testdata/sf0.01"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in op2_bit_planes(spark, sf).collect()) == [w[:4] for w in expected(rows)]


def test_repeats_of_one_row_are_split(spark, tmp_path):
    docs = spark.range(4000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'again and again' as text")
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows become one task again
    try:
        planes.write_ids(docs, path, FILE, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = expected([(None, "again and again")] * 4000)
    assert sorted(r["start"] for r in planes.read_checksums(spark, path).collect()) == [w[1] for w in want]
    shards = spark.read.parquet(f"{path}/blocks").selectExpr("shard", "size(slices) as n").groupBy("shard").sum("n").collect()
    sizes = [r["sum(n)"] for r in shards]
    assert len(sizes) == 4 and max(sizes) < 2000
