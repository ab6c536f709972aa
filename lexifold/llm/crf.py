"""Quality rules with a linear-chain conditional random field over lines.

Every line of a text is a step of a chain with two states, boilerplate and content. The field is trained here, on a
bounded sample of labelled documents (``FieldOptions.documents_per_class`` of each class): lines of good documents
count as content, lines of bad ones as boilerplate, and spliced documents (a bad one set into a good one) show it
where the states change. Viterbi decoding then marks the lines of every text; a text is kept if its base rules hold
and at least ``min_content`` of the characters of its words stand in content lines.

Defined results: null text counts as empty; a text without a word has content share 0; rows of a null ``doc_id``
and repeated rows stay; an empty table gives an empty table; other columns are ignored. Without labelled documents
of both classes there is nothing to learn from, and every line counts as content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
FEATURES = (
    "one", "words", "symbols", "digits", "sentence_end", "blank", "seen_before", "repeated", "runs", "pipes", "word_length",
    "capitals", "few_words",
)
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


@dataclass(frozen=True)
class FieldOptions:
    """``documents_per_class`` bounds the labelled sample; everything else covers all documents."""

    documents_per_class: int = 2_000
    rounds: int = 40
    rate: float = 0.08
    decay: float = 1e-3
    seed: int = 7
    min_content: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words within windows of ``size`` words that are found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    # Some hashes agree: number the windows exactly, doubling their length.
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    length = 1
    while length < size:
        step = min(length, size - length)
        both = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(both, return_inverse=True)[1]
        length += step
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a UTF-8 text: its five base numbers, the features of each line, and the word bytes of each line."""
    lines = text.split(b"\n")
    split = [line.split() for line in lines]
    words = [w for ws in split for w in ws]
    chars = len(text.decode())
    bare = text.translate(None, b" \t\n\x0b\x0c\r")
    word_chars = chars - (len(text) - len(bare))
    n_symbols = len(bare) - len(bare.translate(None, b"#*$%&|<>"))
    seen: set[bytes] = set()
    n_dup, rows, sizes = 0, [], []
    for line, ws in zip(lines, split, strict=True):
        n = len(ws)
        size = sum(map(len, ws))
        sizes.append(size)
        if not n:
            rows.append((1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
            continue
        dup = line in seen
        n_dup += dup
        seen.add(line)
        runs = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
        rows.append((
            1.0, min(n, 200) / 100, (len(line) - len(line.translate(None, b"#*$%&<>"))) / size * 4,
            (len(line) - len(line.translate(None, b"0123456789"))) / size, float(ws[-1][-1:] in b".!?"), 0.0, float(dup),
            1 - len(set(ws)) / n, runs / n, line.count(b"|") / n, min(size / n, 40) / 10,
            sum(w[:1].isupper() for w in ws) / n, float(n < 4),
        ))
    base = [len(words), word_chars, n_symbols, n_dup, repeated_window_words(words)]
    return base, np.array(rows), np.array(sizes, np.int64)


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """``weights``: features x states; ``moves``: from state x to state; state 1 is content."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest states (Viterbi); of equal paths, the one through content."""
        if len(features) == 0:
            return np.zeros(0, np.int64)
        (m00, m01), (m10, m11) = self.moves.tolist()
        emit = (features @ self.weights).tolist()
        bad, good = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            b0, g0, b1, g1 = bad + m00, good + m10, bad + m01, good + m11
            back.append((g0 >= b0, g1 >= b1))
            bad, good = max(b0, g0) + e0, max(b1, g1) + e1
        state = int(good >= bad)
        path = [state]
        for to_bad, to_good in reversed(back):
            state = int(to_good if state else to_bad)
            path.append(state)
        return np.array(path[::-1])


EVERYTHING = Field(np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (len(FEATURES) - 1)), np.zeros((2, 2)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a padded batch (sequences x steps) and its gradients, by the forward and backward recursions."""
    n, steps = y.shape
    emit = x @ field.weights
    forward, backward = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, steps):
        new = _logsum(forward[:, t - 1, :, None] + field.moves, 1) + emit[:, t]
        forward[:, t] = np.where((t < lengths)[:, None], new, forward[:, t - 1])
    total = _logsum(forward[:, -1], 1)
    for t in range(steps - 2, -1, -1):
        new = _logsum(field.moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t + 1 < lengths)[:, None], new, 0)
    inside = np.arange(steps) < lengths[:, None]
    seen = np.eye(2)[y] * inside[:, :, None]
    single = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    d_weights = np.einsum("ntf,nts->fs", x, seen - single)
    both = inside[:, 1:]
    pair = np.exp(
        forward[:, :-1, :, None] + field.moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
    ) * both[:, :, None, None]
    seen_pair = seen[:, :-1, :, None] * seen[:, 1:, None, :]
    d_moves = (seen_pair - pair).sum(axis=(0, 1))
    score = (emit * seen).sum() + (seen_pair * field.moves).sum() - total.sum()
    return float(score), d_weights, d_moves


def train(good: list[np.ndarray], bad: list[np.ndarray], options: FieldOptions = FieldOptions()) -> Field:
    """A field from the line features of good and of bad documents; ``EVERYTHING`` if there are none of one kind."""
    good, bad = [g for g in good if len(g)], [b for b in bad if len(b)]
    if not good or not bad:
        return EVERYTHING
    rng = np.random.default_rng(options.seed)
    chains = [(g, np.ones(len(g), np.int64)) for g in good] + [(b, np.zeros(len(b), np.int64)) for b in bad]
    for i, b in enumerate(bad):
        g = good[i % len(good)]
        cut = int(rng.integers(0, len(g) + 1))
        chains.append((np.concatenate((g[:cut], b, g[cut:])), np.concatenate((np.ones(cut, np.int64), np.zeros(len(b), np.int64), np.ones(len(g) - cut, np.int64)))))
    chains.sort(key=lambda c: len(c[0]))
    batches = []
    for at in range(0, len(chains), 128):
        part = chains[at : at + 128]
        lengths = np.array([len(y) for _, y in part])
        x, y = np.zeros((len(part), lengths.max(), len(FEATURES))), np.zeros((len(part), lengths.max()), np.int64)
        for i, (xs, ys) in enumerate(part):
            x[i, : len(ys)], y[i, : len(ys)] = xs, ys
        batches.append((x, y, lengths))
    weights, moves = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    step = 0
    for _ in range(options.rounds):
        for i in rng.permutation(len(batches)):
            x, y, lengths = batches[i]
            _, dw, dm = gradient(Field(weights, moves), x, y, lengths)
            step += 1
            for j, (value, d) in enumerate(((weights, dw / len(y)), (moves, dm / len(y)))):
                d = d - options.decay * value
                first[j] = 0.9 * first[j] + 0.1 * d
                second[j] = 0.999 * second[j] + 0.001 * d * d
                value += options.rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Field(weights, moves)


# --- Spark ----------------------------------------------------------------------------------------------------------


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [measure(t or b"")[1].astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(lines, pa.binary())], ["quality", "lines"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, options: FieldOptions = FieldOptions()) -> Field:
    """Train on a sample of the documents that ``labels`` (doc_id, quality) names; only their line features reach the driver."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("labelled"), F.lit(options.seed))
    n = options.documents_per_class
    sample = [one.where(F.col("quality") == q).orderBy(order, "labelled").limit(n) for q in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most twice documents_per_class pairs of numbers
    texts = _texts(documents)
    found = texts.join(chosen, texts["doc_id"] == chosen["labelled"]).select("quality", "doc_id", "text")
    rows = found.select("quality", "text").mapInArrow(_line_features, "quality int, lines binary").collect()
    rows = sorted((r["quality"], bytes(r["lines"])) for r in rows)  # the same field wherever the rows come from
    chains = [[], []]
    for quality, lines in rows:
        chains[quality].append(np.frombuffer(lines, "<f4").reshape(-1, len(FEATURES)).astype(float))
    return train(chains[1], chains[0], options)


def _judge(field: Field, options: FieldOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, features, sizes = measure(text or b"")
                total = int(sizes.sum())
                share = float(sizes[field.decode(features) == 1].sum() / total) if total else 0.0
                failed = base[0] < options.min_words or 100 * base[4] > options.max_repeat_percent * base[0]
                out.append((*base, failed, not failed and share >= options.min_content, share))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [c.split()[0] for c in BASE.split(", ")])

    return run


def judge(documents: DataFrame, field: Field, options: FieldOptions = FieldOptions()) -> DataFrame:
    """Base numbers, content share and verdict of each document; no row is moved."""
    return _texts(documents).mapInArrow(_judge(field, options), BASE)


def content_lines(documents: DataFrame, field: Field) -> DataFrame:
    """``doc_id, line, text, content`` of every line of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or b""
                states, lines = field.decode(measure(text)[1]), text.decode().split("\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines), pa.array(states == 1)],
                    ["doc_id", "line", "text", "content"],
                )

    return _texts(documents).mapInArrow(run, "doc_id long, line long, text string, content boolean")


def keep(documents: DataFrame, field: Field, options: FieldOptions = FieldOptions()) -> DataFrame:
    """The rows of ``documents`` (doc_id, text and any others) that the verdict keeps; no row is moved."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = _judge(field, options)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            few = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), texts], ["doc_id", "text"])
            kept = next(verdict(iter([few]))).column("kept")
            yield batch.filter(kept)

    return documents.mapInArrow(run, documents.schema)
