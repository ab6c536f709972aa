from collections import defaultdict

from lexifold.llm import mixing
from pyspark.sql import functions as F


def fill(budget, children):
    """(capacity, weight) each: by raising a common level until the budget is spent; exact fractions, not rounded."""
    given, left = [0.0] * len(children), float(budget)
    free = [i for i, (c, w) in enumerate(children) if w > 0 and c > 0]
    while free and left > 1e-9:
        level = min([left / sum(children[i][1] for i in free)] + [(children[i][0] - given[i]) / children[i][1] for i in free])
        for i in free:
            given[i] += level * children[i][1]
        left = budget - sum(given)
        free = [i for i in free if children[i][0] - given[i] > 1e-9]
    return given


def budgets(leaves, mixture, weight):
    """The same tree by recursion; ``leaves``: path -> tokens."""
    out = {}

    def capacity(path):
        if path in leaves:
            return leaves[path] * mixture.max_epochs if all(weight(path[: k + 1]) for k in range(len(path))) else 0
        return sum(capacity(p) for p in {leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})

    def walk(path, budget):
        if path in leaves:
            out[path] = budget
            return
        children = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
        for child, given in zip(children, fill(budget, [(capacity(c), weight(c)) for c in children]), strict=True):
            walk(child, given)

    walk((), min(mixture.budget, capacity(())))
    return out


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, domain string, lang string, source string, epoch string, leaf int, row string, _id string")


def make(n, domain, lang, source, words, at=0):
    return [(at + i, "w " * words, domain, lang, source, "x", 1, "y", "z") for i in range(n)]


WEIGHTS = {"a": 3, "b": 1, "*/en": 2, "a/de": 5, "a/en/s2": 4, "c": 0, "b/*/s9": 0}


def weight_of(path):
    named = {("a",): 3, ("b",): 1, ("c",): 0, ("a", "de"): 5, ("a", "en", "s2"): 4}
    if path in named:
        return named[path]
    if len(path) == 2 and path[1] == "en":
        return 2
    return 0 if len(path) == 3 and path[0] == "b" and path[2] == "s9" else 1


def test_budgets_and_prefixes(spark):
    docs, at = [], 0
    for n, domain, lang, source, words in (
        (30, "a", "en", "s1", 7), (4, "a", "en", "s2", 5), (3, "a", "de", "s1", 2), (50, "b", "en", "s1", 3), (9, "b", "fr", "s9", 4),
        (5, "c", "en", "s1", 6), (1, "b", "fr", "s3", 0), (12, "b", "es", "s4", 11),
    ):
        docs += make(n, domain, lang, source, words, at)
        at += n
    for budget in (0, 1, 37, 200, 500, 10_000):
        mixture = mixing.Mixture(budget=budget, weights=WEIGHTS, max_epochs=3, seed=5)
        tokens = defaultdict(int)
        for d in docs:
            tokens[d[2:5]] += len(d[1].split())
        want = budgets(dict(tokens), mixture, weight_of)
        rows = mixing.mix(rows_of(spark, docs), mixture).collect()
        took, epochs = defaultdict(int), defaultdict(lambda: defaultdict(set))
        for r in rows:
            leaf = (r["domain"], r["lang"], r["source"])
            took[leaf] += r["take_tokens"]
            epochs[leaf][r["epoch"]].add(r["doc_id"])
            assert r["n_tokens"] == len(r["text"].split()) and r["take_tokens"] <= r["n_tokens"]
        for leaf, exact in want.items():
            assert abs(took[leaf] - exact) < 3, (budget, leaf)
            for epoch in range(max(epochs[leaf], default=0)):  # all but the last are whole
                assert len(epochs[leaf][epoch]) == sum(d[2:5] == leaf for d in docs)
        assert sum(took.values()) == min(budget, sum(3 * t for leaf, t in tokens.items() if leaf[0] != "c" and leaf[2] != "s9"))


def test_order_is_seeded_and_does_not_depend_on_partitions(spark):
    docs = make(200, "a", "en", "s1", 3)
    mixture = mixing.Mixture(budget=301, max_epochs=2, seed=1)
    one = {r["doc_id"] for r in mixing.mix(rows_of(spark, docs), mixture).collect()}
    two = {r["doc_id"] for r in mixing.mix(rows_of(spark, docs).repartition(9), mixture).collect()}
    other = {r["doc_id"] for r in mixing.mix(rows_of(spark, docs), mixing.Mixture(budget=301, max_epochs=2, seed=2)).collect()}
    assert one == two != other and len(one) == 101


def test_nulls_ties_empty(spark):
    docs = [(None, None, None, None, None, "x", 1, "y", "z"), (None, "a b", None, "en", None, "x", 1, "y", "z"), (1, "a b", "", "en", "", "x", 1, "y", "z"),
            (1, "a b", "", "en", "", "x", 1, "y", "z"), (2, "", "", "en", "", "x", 1, "y", "z"), (3, "long " * 50_000, "d", "en", "s", "x", 1, "y", "z")]
    frame = rows_of(spark, docs)
    everything = mixing.mix(frame, mixing.Mixture(budget=10**9, max_epochs=1)).collect()
    assert len(everything) == 5 and set(everything[0].asDict()) == set(frame.columns) | {"n_tokens", "take_tokens"}  # the leaf without tokens has no budget
    assert mixing.mix(frame, mixing.Mixture(percent=50)).agg(F.sum("take_tokens")).first()[0] > 0
    assert mixing.mix(frame.limit(0), mixing.Mixture(percent=50)).count() == 0


def test_words(spark):
    texts = [None, "", " \t\n", "a", " a  b\nc ", "a\x0bb\x0cc\rd", "a b   c", "x\x1cy"]
    import re

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.n_words(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in rows.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
