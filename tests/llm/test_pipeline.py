"""Every stage against a plain version of what it decides, on the rows that the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from lexifold.llm import crf, pieces, secret_scan
from test_shingles import expected as similar_to

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stages") / name)
        found.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return {name: pair for (name, _), pair in zip(corpus_pipeline.STAGES, out, strict=True)}


def test_quality(spark, stages):
    before, after = stages["quality_rules"]
    assert after.columns == before.columns
    field = crf.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    options, kept = crf.FieldOptions(), {}
    for row in before.collect():
        base, features, sizes = crf.measure((row["text"] or "").encode())
        total = sum(sizes)
        share = sum(s for s, state in zip(sizes, field.decode(features), strict=True) if state) / total if total else 0
        if base[0] >= options.min_words and 100 * base[4] <= options.max_repeat_percent * base[0] and share >= options.min_content:
            kept[row["doc_id"]] = row
    assert {r["doc_id"]: r for r in after.collect()} == kept
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in quality.items() if q == 1 and len(re.findall(r"\S+", before.where(before.doc_id == i).first()["text"])) >= 20][:60]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    assert after.columns == before.columns
    top, _ = similar_to([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, c in top.items() if i == c)


def test_secrets(stages):
    before, after = stages["secret_scans"]
    assert after.columns == before.columns
    masked = 0
    texts = {r["doc_id"]: r for r in after.collect()}
    for row in before.collect():
        text, out, end = row["text"] or "", "", 0
        for _, a, b in secret_scan.find_spans(text):
            if a >= end:
                out += text[end:a] + "[SECRET]"
            end = max(end, b)
        out += text[end:]
        masked += out != text
        got = texts.pop(row["doc_id"])
        assert got["text"] == out and got["n_chars"] == (len(out) if out != text else row["n_chars"])
    assert masked and not texts


def test_mixture(stages):
    before, after = stages["source_mixture"]
    assert after.columns == before.columns
    rows = {r["doc_id"]: r for r in before.collect()}
    got = Counter(r["doc_id"] for r in after.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    tokens = sum(len((r["text"] or "").split()) for r in rows.values())
    taken = defaultdict(int)
    for i, n in got.items():
        taken[rows[i]["lang"]] += n * len((rows[i]["text"] or "").split())
    longest = max(len((r["text"] or "").split()) for r in rows.values())
    assert abs(sum(taken.values()) - tokens) <= longest * len({(r["lang"], r["source"]) for r in rows.values()})


def test_token_ids(spark, stages):
    before, after = stages["sentencepiece_ids"]
    lattice = pieces.PieceLattice(corpus_pipeline.tokenizer_file("piece_bpe_32k.model"))
    rows = Counter((r["doc_id"], r["text"]) for r in before.collect())
    got = after.collect()
    assert Counter((r["doc_id"], lattice.decode(r["ids"])) for r in got) == rows
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)


def test_near_duplicates_by_row(spark):
    """Different texts of one id stay, rows of a null id are in groups, other columns come through."""
    def text(k, n=40):
        return " ".join(f"w{k}x{i}" for i in range(n))

    near = text(1).replace("w1x20", "changed")
    rows = [
        (1, text(1), "a", 1), (1, text(2), "b", 2), (2, text(3), "c", 3), (2, text(3), "c", 3), (3, near + " and", "d", 4), (None, text(4), "e", 5),
        (None, text(4), "f", 6), (None, text(2) + " more", "g", 7), (4, None, "h", 8), (5, "", "i", 9), (None, None, "j", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string, of_id int").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in got.collect())
    assert kept == [(0, "w4x0"), (1, "w1x0"), (1, "w2x0"), (2, "w3x0"), (3, "w1x0"), (4, "")]


def test_other_columns_come_through(spark):
    extra = {"domain": "mine", "n_tokens": "7", "take_tokens": "8", "epoch": "9", "_new": "n", "_blob": "b", "_spans": "s", "blob": "x", "row": "r", "masked": "m", "component": "c"}
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{words} text {i} " + f"password = hunter{i}hunter", "en", "src0", 5, *extra.values()) for i in range(3)]
    rows = [(i, t.replace("word", f"w{i}"), *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["doc_id"] for r in got} == {0, 1, 2}, name
        assert all(r[c] == v for r in got for c, v in extra.items()), name


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [(None, long, None, None, None), (None, long, "en", "s", 1), (1, long, "en", "src0", 1), (1, long, "en", "src0", 1), (2, None, None, None, None), (3, "", "en", "src1", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == schema.names
    last = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} <= {None, 1}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0, name
