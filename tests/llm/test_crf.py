import itertools
import re

import numpy as np
from lexifold.llm import crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {w: windows.count(w) for w in set(windows)}
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    earlier, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in earlier
            earlier.add(line)
    n = len(words)
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), failed


TEXTS = [
    None, "", " \n\t\r\n", "a", "a " * 7, "a " * 8, "a " * 9, "é ü x y\x1cz #*$%&|<>", "same\nsame\n\nsame \nsame",
    " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(50, 90)), "b c " * 20_000, "x" * 300_000,
    " ".join(str(i % 9) for i in range(40)), "\n".join(f"line {i} with words enough" for i in range(3000)),
]


def test_base_numbers(spark):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(TEXTS)] + [(None, "q", 1, 1.0)] * 2, "doc_id long, text string, kept int, n_words double")
    rows = crf.judge(docs, crf.EVERYTHING).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) + 2
    for i, text in enumerate(TEXTS):
        r = got[i]
        expected = plain(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected
        assert r["kept"] == (not expected[-1])
    assert crf.judge(docs.limit(0), crf.EVERYTHING).count() == 0


def test_field_decodes_and_learns():
    rng = np.random.default_rng(0)
    field = crf.Field(rng.normal(size=(len(crf.FEATURES), 2)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, len(crf.FEATURES)))
    emit = x @ field.weights

    def score(path):
        return sum(emit[t, s] for t, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = list(itertools.product((0, 1), repeat=7))
    assert tuple(field.decode(x)) == max(paths, key=score)
    # the gradient is that of the likelihood, by all paths and by differences
    y = np.array([[0, 1, 1, 0, 1, 1, 1]])
    value, dw, dm = crf.gradient(field, x[None], y, np.array([7]))
    assert np.isclose(value, score(y[0]) - np.log(sum(np.exp(score(p)) for p in paths)))
    padded, _, _ = crf.gradient(field, np.concatenate((x, x))[None], np.concatenate((y, y), axis=1), np.array([7]))
    assert np.isclose(padded, value)
    for array, d in ((field.weights, dw), (field.moves, dm)):
        for at in ((0, 0), (1, 1)):
            array[at] += 1e-5
            up, _, _ = crf.gradient(field, x[None], y, np.array([7]))
            array[at] -= 1e-5
            assert abs((up - value) / 1e-5 - d[at]) < 1e-3
    assert crf.train([], [x]) is crf.EVERYTHING and len(field.decode(x[:0])) == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = crf.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = crf.judge(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("n_words >= 20").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] or r["base_failed"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
    lines = crf.content_lines(docs, field)
    assert lines.where("doc_id = 5").count() == docs.where("doc_id = 5").first()["text"].count("\n") + 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "doc_id long, quality int")
    assert crf.fit(docs, none) is crf.EVERYTHING
