import zlib

import numpy as np
from lexifold.llm import toxicity


def test_machine_learns_what_linear_weights_cannot():
    rng = np.random.default_rng(4)
    fill = [f"w{i}" for i in range(40)]
    texts, y = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.5
        texts.append(" ".join([*rng.choice(fill, 8), *(["insult"] if insult else []), *(["group"] if group else [])]))
        y.append(int(insult and group))
    slots = [toxicity.slots_of(t, 1 << 14) for t in texts]
    options = toxicity.MachineOptions(slots=1 << 14)
    machine = toxicity.train([s for s, v in zip(slots, y) if not v], [s for s, v in zip(slots, y) if v], sum(y) / len(y), options)
    place = {int(s): i for i, s in enumerate(machine.slots)}

    def score(text):
        return machine.score(np.array([place[s] for s in toxicity.slots_of(text, 1 << 14).tolist() if s in place], np.int64))

    assert score("w1 w2 insult group") > 0.9 and max(score("w1 insult"), score("w2 group"), score("")) < 0.2
    # the pairwise term as it is defined
    places = np.arange(min(5, len(machine.slots)))
    pairs = sum(machine.vectors[i] @ machine.vectors[j] for i in places for j in places if i < j)
    total = machine.intercept + machine.weights[places].sum() + pairs
    assert np.isclose(machine.score(places), 1 / (1 + np.exp(-total)))


def plain_score(machine, text):
    """The definition, pair by pair."""
    import itertools
    import math

    weight = {int(s): (w, v) for s, w, v in zip(machine.slots, machine.weights.tolist(), machine.vectors.tolist())}
    slots = set()
    for word in text.lower().split():
        word = word.strip(toxicity.ENDS)
        for term in [word] * bool(word) + [f"^{word[:k]}" for k in (4, 5) if len(word) > k]:
            slots.add(zlib.crc32(term.encode()) % machine.n_slots)
    here = [weight[s] for s in sorted(slots) if s in weight]
    total = machine.intercept + sum(w for w, _ in here)
    total += sum(sum(a * b for a, b in zip(v, u)) for (_, v), (_, u) in itertools.combinations(here, 2))
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_pairs_whose_words_alone_tell_nothing():
    """Toxic exactly if both words occur or neither does; the share of toxic texts with either word is that of all."""
    rng = np.random.default_rng(9)
    fill = [f"w{i}" for i in range(40)]

    def made(n):
        texts, y = [], []
        for _ in range(n):
            insult, group = rng.random(2) < 0.5
            texts.append(" ".join([*rng.choice(fill, 8), *(["insult"] if insult else []), *(["group"] if group else [])]))
            y.append(int(insult == group))
        return texts, y

    options = toxicity.MachineOptions(slots=1 << 14)
    texts, y = made(4000)
    slots = [toxicity.slots_of(t, 1 << 14) for t in texts]
    sides = [[s for s, v in zip(slots, y) if v == side] for side in (0, 1)]
    alone = toxicity.choices(*sides, options)[0]
    assert not np.isin(toxicity.slots_of("insult group", 1 << 14), alone).any()
    machine = toxicity.train(*sides, sum(y) / len(y), options)
    held, truth = made(2000)
    right = [(plain_score(machine, t) >= 0.5) == bool(v) for t, v in zip(held, truth)]
    assert np.mean(right) > 0.99


def test_one_row_of_a_labelled_id_is_learned_from(spark):
    rows = [(1, f"awful text {i}") for i in range(3000)] + [(2, "kind text"), (3, "kind words"), (4, "awful words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    seen = []
    machine = toxicity.train

    def count(good, bad, share, options):
        seen.append((len(good), len(bad)))
        return machine(good, bad, share, options)

    toxicity.train = count
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = machine
    assert seen == [(2, 2)]


def test_rows_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "bad bad", 9.0), (4, "x " * 100_000, 9.0)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == 5 and all(0 <= r["score"] < 1e-6 for r in rows)
    assert toxicity.score(docs.limit(0), machine).count() == 0
    both = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, both)).collect())


def test_query_on_held_out_rows(spark):
    from lexifold.llm.queries import op6_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    learned = [(r["doc_id"], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    machine = toxicity.fit(docs, spark.createDataFrame(learned, "doc_id long, toxic int"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id % 7 = 0").collect()}
    assert all(np.isclose(r["score"], plain_score(machine, texts[r["doc_id"]]), rtol=1e-9, atol=0) for r in rows if r["doc_id"] in texts)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(p and t for p, t in held)
    # about one in ten of these toxic rows holds none of the words that mark the others
    assert hits >= 0.85 * sum(t for _, t in held) and hits >= 0.95 * sum(p for p, _ in held)
