"""Sampled SentencePiece segmentations, and lossless decoding.

The model file gives the pieces; a text's lattice has an arc for every piece that matches at a place, and for every
character that no piece is an arc of its UTF-8 bytes as byte pieces. Segmentations are drawn with probability
proportional to the product of their arcs' weights: *forward filtering* sums the weight of all ways to each place,
*backward sampling* walks back from the end, choosing each arc by its share. A piece's weight is
``(rank + 1) ** -sharpness`` by its rank in the model (byte pieces rank last): the model file is ordered by
usefulness, but holds no probabilities.

No piece has a space mark inside, only at its start, so no arc crosses from a character to a following run of
spaces; line ends are always bytes. The lattice therefore falls into independent stretches (a run of spaces with the
characters after it, or a line end). A task takes a few hundred texts at a time and filters the different stretches in
them, and then samples all their occurrences, by arrays; stretches of more than ``SHORT`` characters, or so unlikely
that doubles do not hold their weight, go one by one with rescaling. Which way a stretch goes, and all its numbers,
depend on the stretch alone.

A draw is a hash of the row key, the stretch's number in its text and the step, so the sample does not depend on how
rows are spread over tasks. Encoding is lossless: there is no normalisation, a space is the mark, and a mark that is
itself in the text becomes bytes.

Defined results: null text counts as empty and gives no ids; a null key counts as the empty string; repeated rows
give the same sample; texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Fixed value: the character that stands for a space in pieces.
MARK = "▁"
STRETCHES = re.compile(r"\n| *[^ \n]+| +")
SHORT = 32
LEAST_WAYS = 1e-250  # of a stretch that plain doubles hold; below, it is filtered with rescaling
CHARS = 1_200_000  # of the texts that are sampled together
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SampleOptions:
    """``sharpness``: weights are ranks to the power of its negative; 0 draws all segmentations alike."""

    sharpness: float = 1.0
    seed: int = 23


class PieceLattice:
    """The pieces of a model, and samples of segmentations."""

    def __init__(self, model_file: str, options: SampleOptions = SampleOptions()):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.options = options
        self.text_of: dict[int, bytes] = {}
        self.bytes_at = [0] * 256
        pieces: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at[value], self.text_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                self.text_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark inside: stretches would not be independent")
        if any("\n" in p for p in pieces):
            raise ValueError("a piece has a line end: stretches would not be independent")
        first = min(pieces.values(), default=0)
        size = model.get_piece_size()
        self.texts = pa.array([self.text_of.get(i) for i in range(size)], pa.large_binary())
        # pieces by their text with plain spaces; a mark in a text is a character without a piece
        self.arcs = {p.replace(MARK, " "): (i, (i - first + 1.0) ** -options.sharpness) for p, i in pieces.items()}
        self.byte_weight = (size - first + 1.0) ** -options.sharpness
        self.longest = max(map(len, self.arcs), default=1)
        # every beginning of a piece, by hash, so that a walk from a place stops where no piece goes on
        begins = sorted({p[:k] for p in self.arcs for k in range(1, len(p) + 1)})
        self.begins = set(begins)
        hashes = np.zeros(len(begins), np.uint64)
        for k in range(self.longest):
            on = np.array([len(p) > k for p in begins], bool)
            code = np.array([ord(p[k]) if len(p) > k else 0 for p in begins], np.uint64)
            hashes = np.where(on, (hashes + code + np.uint64(1)) * MIX, hashes)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        found = [self.arcs.get(begins[i], (-1, 0.0)) for i in order]
        # where the hash of a single character is
        singles = (np.arange(0x10000, dtype=np.uint64) + np.uint64(1)) * MIX
        self.spot_of = np.minimum(np.searchsorted(self.hashes, singles), len(self.hashes) - 1)
        self.piece_at, self.weight_at = np.array([f[0] for f in found], np.int32), np.array([f[1] for f in found])

    def filtered(self, stretch: str) -> list:
        """By end place of the stretch: the arcs into it as (cumulated share, start, ids), by forward filtering."""
        n = len(stretch)
        ways = [0.0] * (n + 1)
        ways[0] = 1.0
        into: list[list] = [[] for _ in range(n + 1)]
        arcs, begins = self.arcs, self.begins
        for at in range(n):
            here = ways[at]
            single = False
            for end in range(at + 1, min(n, at + self.longest) + 1):
                part = stretch[at:end]
                if part not in begins:
                    break
                if part in arcs:
                    i, weight = arcs[part]
                    into[end].append((here * weight, at, (i,)))
                    ways[end] += here * weight
                    single |= end == at + 1
            if not single:
                ids = tuple([self.bytes_at[b] for b in stretch[at].encode()])
                weight = here * self.byte_weight ** len(ids)
                into[at + 1].append((weight, at, ids))
                ways[at + 1] += weight
            if ways[at + 1] < 1e-200:  # scale what is still open, so that long stretches do not vanish
                scale = 1e200
                for end in range(at + 1, min(n, at + self.longest) + 1):
                    ways[end] *= scale
                    into[end] = [(w * scale, a, ids) for w, a, ids in into[end]]
        return [self._shares(arcs, total) for arcs, total in zip(into, ways, strict=True)]

    @staticmethod
    def _shares(arcs: list, total: float):
        if len(arcs) < 2:
            return arcs[0][1:] if arcs else None
        out, upto = [], 0.0
        for weight, start, ids in arcs:
            upto += weight
            out.append((upto / total, start, ids))
        return out

    def sample_long(self, stretch: str, start: np.uint64, number: int) -> list[int]:
        """A sample of one stretch of any length."""
        table, at, back, step = self.filtered(stretch), len(stretch), [], 0
        while at:
            arcs = table[at]
            if type(arcs) is tuple:
                at, piece = arcs
            else:
                u = float(draws(np.array([start]), np.array([number]), step)[0])
                at, piece = next((a for share, *a in arcs if u < share), arcs[-1][1:])
            step += 1
            back.append(piece)
        return [i for piece in reversed(back) for i in piece]

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """A sampled segmentation of each text, drawn by its key."""
        seed = self.options.seed & (1 << 64) - 1
        starts = [np.uint64(xxh64(k.encode(), seed)) for k in keys]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            stretches, at = STRETCHES.findall(text), 0
            while at < len(stretches):
                if len(text) <= CHARS:
                    chars, to = size + len(text), len(stretches)
                else:  # a very long text is taken in several groups
                    chars, to = size, at
                    while to < len(stretches) and chars < CHARS:
                        chars += len(stretches[to])
                        to += 1
                group.append((i, at, stretches[at:to]))
                at, size = to, chars
                if size >= CHARS:
                    self._sample(group, starts, parts)
                    group, size = [], 0
        if group:
            self._sample(group, starts, parts)
        none = np.zeros(0, np.int32)
        return [np.concatenate(p) if p else none for p in parts]

    def _lattices(self, stretches: list[str]):
        """Of short stretches: node numbers, and the arcs into each node with their shares, by forward filtering."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(first, lengths)  # in its stretch
        left = np.repeat(lengths, lengths) - place
        node = np.arange(len(codes)) + np.repeat(np.arange(len(stretches)), lengths)
        live, rolled = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        arcs = []
        for k in range(1, self.longest + 1):
            inside = left[live] >= k
            live, rolled = live[inside], rolled[inside]
            if not len(live):
                break
            rolled = (rolled + codes[live + k - 1] + np.uint64(1)) * MIX
            if k == 1:
                spot = self.spot_of[np.minimum(codes, 0xFFFF).astype(np.int64)]
                beyond = codes > 0xFFFF
                if beyond.any():
                    spot[beyond] = np.minimum(np.searchsorted(self.hashes, rolled[beyond]), len(self.hashes) - 1)
            else:
                spot = np.minimum(np.searchsorted(self.hashes, rolled), len(self.hashes) - 1)
            on = self.hashes[spot] == rolled
            live, rolled, spot = live[on], rolled[on], spot[on]
            piece = self.piece_at[spot]
            whole = piece >= 0
            arcs.append((live[whole], np.full(int(whole.sum()), k), piece[whole], self.weight_at[spot[whole]]))
            if k == 1:
                single[live[whole]] = True
        bare = np.flatnonzero(~single)  # characters that are no piece: their code, negative
        n_bytes = 1 + (codes[bare] >= 0x80).astype(int) + (codes[bare] >= 0x800) + (codes[bare] >= 0x10000)
        arcs.append((bare, np.ones(len(bare), int), -1 - codes[bare].astype(np.int64), self.byte_weight**n_bytes))
        at, size, piece, weight = (np.concatenate(c) for c in zip(*arcs, strict=True))
        ways = np.zeros(len(codes) + len(stretches))
        ways[first + np.arange(len(stretches))] = 1.0
        order = np.lexsort((size, place[at]))
        at, size, piece, weight = at[order], size[order], piece[order], weight[order]
        start, end = node[at], node[at] + size
        share = np.empty(len(at))
        # arcs of one start place and size have different ends
        cuts = np.flatnonzero(np.diff(place[at] * 64 + size)) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(at)])).tolist(), strict=True):
            share[a:b] = ways[start[a:b]] * weight[a:b]
            ways[end[a:b]] += share[a:b]
        reached = ways[end]
        share = np.divide(share, reached, out=np.zeros_like(share), where=reached > 0)
        order = np.argsort(end, kind="stable")
        end, upto = end[order], share[order]
        begin = np.searchsorted(end, np.arange(len(ways) + 1))
        arcs_into = np.diff(begin)
        for k in range(1, int(arcs_into.max(initial=1))):  # shares are added up within a node, so that no other stretch matters
            at = begin[:-1][arcs_into > k] + k
            upto[at] += upto[at - 1]
        last = first + lengths + np.arange(len(stretches))
        return last, start[order], piece[order], upto, begin, ways[last] < LEAST_WAYS

    def _sample(self, group: list, starts: list, parts: list) -> None:
        """Samples the stretches of ``group`` (text, number of the first stretch, stretches) into ``parts``."""
        counts = [len(s) for _, _, s in group]
        every = [s for _, _, ss in group for s in ss]
        different = list(dict.fromkeys(every))
        place_of = dict(zip(different, range(len(different)), strict=True))
        code = np.fromiter(map(place_of.__getitem__, every), np.int64, len(every))
        long = np.array([len(s) > SHORT for s in different], bool)
        number = np.concatenate([np.arange(at, at + n) for (_, at, _), n in zip(group, counts, strict=True)])
        row_start = np.repeat(np.array([starts[i] for i, _, _ in group], np.uint64), counts)
        short_of = np.cumsum(~long) - 1  # long ones, and those found to be faint below, are sampled one by one
        last, start, piece, upto, begin, faint = self._lattices([s for s, x in zip(different, long, strict=True) if not x] or [" "])
        long[~long] = faint[: int((~long).sum())]
        is_long = long[code]
        who = np.flatnonzero(~is_long)
        node = last[short_of[code[who]]]
        total, taken, step = np.zeros(len(code), np.int64), [], 0
        root = np.zeros(len(begin) - 1, bool)
        root[np.diff(begin) == 0] = True
        while len(who):
            arc = begin[node]
            many = np.flatnonzero(begin[node + 1] - arc > 1)
            if len(many):
                at, stop = arc[many], begin[node[many] + 1] - 1
                goal = draws(row_start[who[many]], number[who[many]], step)
                on = np.arange(len(many))
                while len(on):
                    on = on[(at[on] < stop[on]) & (upto[at[on]] <= goal[on])]
                    at[on] += 1
                arc[many] = at
            found = piece[arc]
            bare = found < 0
            size = np.ones(len(who), np.int64)
            if bare.any():
                char = -1 - found[bare].astype(np.int64)
                size[bare] = 1 + (char >= 0x80).astype(int) + (char >= 0x800) + (char >= 0x10000)
            taken.append((who, found, size, total[who]))
            total[who] += size
            node = start[arc]
            more = ~root[node]
            who, node, step = who[more], node[more], step + 1
        singles = {j: self.sample_long(different[code[j]], row_start[j], int(number[j])) for j in np.flatnonzero(is_long).tolist()}
        for j, ids in singles.items():
            total[j] = len(ids)
        end = np.cumsum(total)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for who, found, size, before in taken:
            to = end[who] - before - size
            plain = found >= 0
            out[to[plain]] = found[plain]
            for place, char in zip(to[~plain].tolist(), (-1 - found[~plain].astype(np.int64)).tolist(), strict=True):
                octets = chr(char).encode()
                out[place : place + len(octets)] = [self.bytes_at[b] for b in octets]
        for j, ids in singles.items():
            out[end[j] - total[j] : end[j]] = ids
        ends = np.concatenate(([0], end))[np.cumsum([0, *counts])]
        for (i, _, _), a, b in zip(group, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            parts[i].append(out[a:b])

    def decode(self, ids) -> str:
        return b"".join([self.text_of[i] for i in ids]).decode()

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; null counts as no ids. Pieces taken one after the other are the texts already."""
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        taken = self.texts.take(ids.flatten())
        if taken.null_count:
            raise ValueError("an id that no text can give")
        edges = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        ends = edges[np.concatenate(([0], np.cumsum(lengths)))] if len(taken) else np.zeros(len(ids) + 1, np.int64)
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), data])
        return texts.cast(pa.large_string()).cast(pa.string())


def xxh64(data: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def draws(start: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) of (row, stretch, step), by a splitting mix."""
    x = start + ((number.astype(np.uint64) << np.uint64(24)) + np.uint64(step + 1)) * MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


def worker_lattice(model_file: str, options: SampleOptions) -> PieceLattice:
    """The lattice of this worker process, which later tasks use again with what it remembers."""
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("_held_lattices", {})
    name = (model_file, repr(options))
    if name not in held:
        held[name] = PieceLattice(model_file, options)
    return held[name]


def encode(
    documents: DataFrame, model_file: str, options: SampleOptions = SampleOptions(), key: Column | None = None, keep: tuple = ()
) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents`` (doc_id, text), and the columns of ``keep``.

    ``key`` (``doc_id`` if not given) seeds the row's sample.
    """
    by = (F.col("doc_id") if key is None else key).cast("string")
    rows = documents.select("doc_id", *keep, F.coalesce(by, F.lit("")).alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = rows.drop("_key", "_text").schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_lattice(model_file, options)
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            found = lattice.encode(batch.column("_text").to_pylist(), batch.column("_key").to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), ids], schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, options: SampleOptions = SampleOptions(), keep: tuple = ()) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``, and the columns of ``keep``; null ids count as none."""
    rows = encoded.select("doc_id", *keep, F.col("ids").alias("_ids"))
    schema = rows.drop("_ids").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = worker_lattice(model_file, options)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = lattice.decode_lists(batch.column("_ids"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), texts], schema.names)

    return rows.mapInArrow(run, schema)
