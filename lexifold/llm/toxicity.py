"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its different words, without punctuation at their ends and in lower case, and the first 4
and 5 characters of longer ones; each is hashed to a slot. The machine scores a linear weight per slot and, through
a short vector per slot, the interaction of every pair of slots that occur together: an insult next to a mention of a
group can weigh more than the two alone.

It is fitted on at most ``documents_per_class`` labelled documents of each class, one row for each label. Which slots
take part is settled on a fifth of that sample, held out from the others, by the log loss of four choices (of nearly equal ones the smallest): slots
whose own frequencies differ clearly between the classes, those that differ a little, the first kind and the slots
whose occurrence together with some other slot differs most between the classes, or all slots. So neither a pair whose
words alone tell nothing nor a rare word is lost where it helps, and a few thousand documents do not drown in chance
differences of tens of thousands of slots where it does not. The chosen kind is then fitted on the whole sample, and
the intercept moved from the sample's share of toxic documents to that of all labelled ones. Scoring covers whole texts
and moves no row.

Defined results: null and empty texts score what the intercept says; rows of a null ``doc_id`` and repeated rows
stay; of several rows of a labelled ``doc_id`` the one of the smallest text hash is learned from; an empty table gives
an empty table; other columns are ignored. Without labelled documents of both classes every score is the share of
toxic documents among the labelled ones (0 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Mean log losses this near to each other are held to be even.
EVEN = 0.01
ENDS = ".,;:!?\"'()[]{}<>«»“”„…*#$%&|/\\-_~`^=+"


@dataclass(frozen=True)
class MachineOptions:
    """``documents_per_class`` bounds the labelled sample; everything else covers all documents.

    ``clear`` and ``slight`` are differences of a slot's two frequencies, in standard errors. Pairs are looked at among
    slots that at least ``pair_share`` of a class have; the ``pair_slots`` with the greatest differences are taken.
    """

    documents_per_class: int = 4_000
    slots: int = 1 << 20
    clear: float = 5.0
    slight: float = 3.5
    pair_share: float = 0.02
    pair_slots: int = 256
    least_documents: int = 4
    factors: int = 4
    rounds: int = 30
    rate: float = 0.05
    decay: float = 3e-4
    seed: int = 11


def terms(word: str) -> list[str]:
    """The terms of one word, given in lower case."""
    word = word.strip(ENDS)
    if not word:
        return []
    return [word, *(f"^{word[:k]}" for k in (4, 5) if len(word) > k)]


def slots_of(text: str, slots: int) -> np.ndarray:
    """The different slots of a text, sorted."""
    found = {zlib.crc32(t.encode()) % slots for w in set(text.lower().split()) for t in terms(w)}
    return np.array(sorted(found), np.int64)


@dataclass(frozen=True)
class Machine:
    """``slots``: the slots that count, sorted; their ``weights`` and ``vectors``."""

    intercept: float
    slots: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    n_slots: int

    def score(self, places: np.ndarray) -> float:
        """Of a text with the slots at ``places`` of ``self.slots``."""
        v = self.vectors[places]
        total = self.intercept + self.weights[places].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _present(rows: list[np.ndarray], slots: np.ndarray, n_slots: int) -> list[np.ndarray]:
    """Places in ``slots`` of what each row has of them."""
    place = np.full(n_slots, -1, np.int64)
    place[slots] = np.arange(len(slots))
    return [p[p >= 0] for p in (place[r] for r in rows)]


def paired_slots(good: list[np.ndarray], bad: list[np.ndarray], options: MachineOptions) -> np.ndarray:
    """The slots whose occurrence together with some other slot differs most between the classes, chance taken off.

    Compared are covariances within each class, so a slot that differs alone does not make pairs of all it meets.
    """
    counts = [np.bincount(np.concatenate(part), minlength=options.slots) for part in (good, bad)]
    frequent = np.flatnonzero((counts[0] >= max(1, options.pair_share * len(good))) | (counts[1] >= max(1, options.pair_share * len(bad))))
    sides = []
    for rows in (good, bad):
        x = np.zeros((len(rows), len(frequent)), np.float32)
        for i, places in enumerate(_present(rows, frequent, options.slots)):
            x[i, places] = 1
        mean = x.mean(0)
        sides.append((x, mean, mean * (1 - mean)))
    (x0, m0, v0), (x1, m1, v1) = sides
    most = np.zeros(len(frequent))
    for at in range(0, len(frequent), 1024):
        part = slice(at, at + 1024)
        together = x1[:, part].T @ x1 / len(x1) - x0[:, part].T @ x0 / len(x0) - np.outer(m1[part], m1) + np.outer(m0[part], m0)
        error = np.sqrt(np.outer(v1[part], v1) / len(x1) + np.outer(v0[part], v0) / len(x0)) + 1e-6
        difference = np.abs(together) / error
        difference[np.arange(difference.shape[0]), np.arange(at, at + difference.shape[0])] = 0
        most[part] = difference.max(1)
    order = np.lexsort((frequent, -most))
    return np.sort(frequent[order[: options.pair_slots]])


def choices(good: list[np.ndarray], bad: list[np.ndarray], options: MachineOptions) -> list[np.ndarray]:
    """The four kinds of slots, each ascending: clear, slight, clear or paired, all."""
    counts = [np.bincount(np.concatenate(part), minlength=options.slots).astype(float) for part in (good, bad)]
    pooled = (counts[0] + counts[1]) / (len(good) + len(bad))
    error = np.sqrt(pooled * (1 - pooled) * (1 / len(good) + 1 / len(bad))) + 1e-12
    differs = np.abs(counts[1] / len(bad) - counts[0] / len(good)) / error
    enough = counts[0] + counts[1] >= options.least_documents
    clear, slight = np.flatnonzero(enough & (differs >= options.clear)), np.flatnonzero(enough & (differs >= options.slight))
    paired = paired_slots(good, bad, options)
    return [clear, slight, np.union1d(clear, paired[enough[paired]]), np.flatnonzero(enough)]


def fitted(good: list[np.ndarray], bad: list[np.ndarray], slots: np.ndarray, options: MachineOptions) -> Machine:
    """A machine on ``slots`` with the intercept of the sample, by Adam on sparse rows."""
    rows, n, k = _present([*good, *bad], slots, options.slots), len(slots), options.factors
    y = np.concatenate((np.zeros(len(good)), np.ones(len(bad))))
    rng = np.random.default_rng(options.seed)
    values = [np.zeros(1), np.zeros(n), rng.normal(0, 0.05, (n, k))]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(options.rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            b, w, v = values
            places = np.concatenate([rows[r] for r in part])
            of = np.repeat(np.arange(len(part)), [len(rows[r]) for r in part])
            vp = v[places]
            xv = np.stack([np.bincount(of, vp[:, f], len(part)) for f in range(k)], axis=1)
            total = b[0] + np.bincount(of, w[places] - 0.5 * (vp * vp).sum(1), len(part)) + 0.5 * (xv**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[part]) / len(part)
            xg = np.bincount(places, g[of], n)
            gxv = np.stack([np.bincount(places, (g[:, None] * xv)[of, f], n) for f in range(k)], axis=1)
            slopes = [np.array([g.sum()]), xg + options.decay * w, gxv - xg[:, None] * v + options.decay * v]
            step += 1
            for j, d in enumerate(slopes):
                first[j] = 0.9 * first[j] + 0.1 * d
                second[j] = 0.999 * second[j] + 0.001 * d * d
                values[j] = values[j] - options.rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(values[0][0]), slots, values[1], values[2], options.slots)


def log_losses(machine: Machine, good: list[np.ndarray], bad: list[np.ndarray]) -> np.ndarray:
    """Of each text."""
    scores = [[machine.score(p) for p in _present(part, machine.slots, machine.n_slots)] for part in (good, bad)]
    return -np.log(np.concatenate((1 - np.array(scores[0]), np.array(scores[1]))))


def best_choice(losses: list[np.ndarray], sizes: list[int]) -> int:
    """The choice of fewest slots that is no worse than the best by more than ``EVEN`` or the standard error of their difference."""
    best = min(losses, key=np.mean)
    near = [k for k, loss in enumerate(losses) if (loss - best).mean() <= max(EVEN, (loss - best).std() / np.sqrt(len(best)))]
    return min(near, key=lambda k: (sizes[k], k))


def train(good: list[np.ndarray], bad: list[np.ndarray], share: float, options: MachineOptions = MachineOptions()) -> Machine:
    """From the slots of harmless and of toxic texts; ``share`` is the true share of toxic ones."""
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not good or not bad:
        none = np.zeros(0, np.int64)
        return Machine(prior, none, np.zeros(0), np.zeros((0, options.factors)), options.slots)
    rng = np.random.default_rng(options.seed + 1)
    out = [rng.permutation(len(part)) % 5 == 0 for part in (good, bad)]
    inside = [[r for r, o in zip(part, mask, strict=True) if not o] for part, mask in zip((good, bad), out, strict=True)]
    outside = [[r for r, o in zip(part, mask, strict=True) if o] for part, mask in zip((good, bad), out, strict=True)]
    best = 0
    if all(inside) and any(outside):
        tried = choices(*inside, options)
        best = best_choice([log_losses(fitted(*inside, slots, options), *outside) for slots in tried], [len(slots) for slots in tried])
    machine = fitted(good, bad, choices(good, bad, options)[best], options)
    return replace(machine, intercept=machine.intercept + prior - float(np.log(len(bad) / len(good))))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, options: MachineOptions = MachineOptions()) -> Machine:
    """Fit on a sample of the documents that ``labels`` (doc_id, toxic) names; only their slots reach the driver."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order, n = F.xxhash64(F.col("labelled"), F.lit(options.seed)), options.documents_per_class
    sample = [known.where(F.col("toxic") == q).orderBy(order, "labelled").limit(n) for q in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most twice documents_per_class pairs of numbers
    texts = _texts(documents)
    found = texts.join(chosen, texts["doc_id"] == chosen["labelled"])
    # An id may have any number of rows: one is left of each before anything is read from the texts.
    found = found.groupBy("labelled").agg(F.min_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("row")).select("row.*")
    n_slots = options.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [slots_of(t or "", n_slots).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(slots, pa.binary())], ["toxic", "slots"])

    rows = sorted((r["toxic"], bytes(r["slots"])) for r in found.mapInArrow(run, "toxic int, slots binary").collect())
    parts: list[list[np.ndarray]] = [[], []]
    for toxic, slots in rows:
        parts[toxic].append(np.frombuffer(slots, "<i4").astype(np.int64))
    return train(parts[0], parts[1], share, options)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row of ``documents`` (doc_id, text); no row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(s): i for i, s in enumerate(machine.slots)}
        known: dict[str, tuple] = {}
        empty = machine.score(np.zeros(0, np.int64))
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                places = set()
                for word in set((text or "").lower().split()):
                    found = known.get(word)
                    if found is None:
                        if len(known) > 300_000:
                            known.clear()
                        slots = (zlib.crc32(t.encode()) % machine.n_slots for t in terms(word))
                        found = known[word] = tuple(place[s] for s in slots if s in place)
                    places.update(found)
                scores.append(machine.score(np.array(sorted(places), np.int64)) if places else empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return _texts(documents).mapInArrow(run, "doc_id long, score double")
