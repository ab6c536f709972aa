"""Token ids in files of bit-plane shuffled blocks.

Documents are ranged by ``doc_id``, tokenised, and every range (a *shard*) becomes one stream of ids that is cut
into blocks of ``block_ids`` ids, whatever the document borders. A block is transposed into 4 byte planes or 32 bit
planes; each plane is compressed with zstandard on its own. The folder then holds

* ``blocks``: shard, block, n_ids, plane lengths, payload (the planes one after the other) and the slices of
  documents in the block,
* ``index``: where each block starts in the whole stream, without payloads,
* ``shards``: where each shard starts in the whole stream.

Files are written and committed by Spark, so a lost executor repeats only its own ranges.

Defined results: null text counts as empty (a document of the end id alone); rows of a null ``doc_id`` come first;
ties of ``doc_id`` are ordered by a hash of the text and keep every row, and
rows equal in both are split over ranges like others; an empty table gives empty files; other
columns are ignored. A document may span any number of blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "shard int, row long, doc_id long, start long, n_tokens long, at long, n long, crc long, ids binary"
BLOCKS = (
    "shard int, block long, n_ids int, first long, planes array<int>, payload binary, "
    "slices array<struct<row:long,doc_id:long,start:long,n_tokens:long,at:long,n:int>>"
)


@dataclass(frozen=True)
class PlaneFormat:
    """``planes``: "byte" (4 to a block) or "bit" (32 to a block)."""

    block_ids: int = 65_536
    planes: str = "byte"
    level: int = 3


class WordTokenizer(dict):
    """Encodes whole texts word by word: a dictionary from words to their ids that learns what it lacks.

    For a tokenizer that drops white space and never joins across it, a text's ids are its words' ids one after the
    other. Words of printable ASCII and the letters of Latin-1 are cut by the tokenizer's own rule and given to its
    model; any other word takes the tokenizer's whole path. Of each kind, twice ``most`` entries are remembered: when
    a generation is full, what was used since the last one is kept.
    """

    # The tokenizer file's splitting rule on lower-case text, and the parts it is right for. The last kind
    # of part takes all other characters of a word, so none is skipped; what the tokenizer takes for a blank is not plain.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+"
    PLAIN = r"(?!.*<\|)[!-~\xdf-\xf6\xf8-\xff]+"

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.cut, self.plain = re.compile(self.RULE).findall, re.compile(self.PLAIN).fullmatch
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes | None] = {}
        # The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = [chr(b if b in shown else next(other)) for b in range(256)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            text, parts = word.decode(), self.parts
            try:
                ids = b"".join([parts[part] if part in parts else self._part(part) for part in self.cut(text.lower())])
            except TypeError:  # a part that only the whole path can take
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes | None:
        if len(self.parts) >= 2 * self.most:
            self.parts.clear()
        ids = None
        if self.plain(part):
            letters = part if part.isascii() else "".join([self.alphabet[b] for b in part.encode()])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        self.parts[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.split()))


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, which later tasks use again with all that it has learnt."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_held_by_path", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def shuffle_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def _block_writer(tokenizer_path: str, end_id: int, form: PlaneFormat):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shard = TaskContext.get().partitionId()
        tokenizer, press = worker_tokenizer(tokenizer_path), zstandard.ZstdCompressor(level=form.level)
        end = np.array([end_id], "<u4").tobytes()
        waiting, slices, held, start, row, block = [], [], 0, 0, 0, 0
        size = 4 * form.block_ids

        def close() -> dict:
            nonlocal waiting, slices, held, block
            ids = np.frombuffer(b"".join(waiting), "<u4")
            planes = [press.compress(p) for p in shuffle_planes(ids, form.planes)]
            out = {
                "shard": shard, "block": block, "n_ids": len(ids), "first": block * form.block_ids,
                "planes": [len(p) for p in planes], "payload": b"".join(planes), "slices": slices,
            }
            waiting, slices, held, block = [], [], 0, block + 1
            return out

        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            closed = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.encode(text or b"") + end
                at, total = 0, len(ids) // 4
                while at < len(ids):
                    part = ids[at : at + size - held]
                    slices.append({"row": row, "doc_id": doc_id, "start": start, "n_tokens": total, "at": at // 4, "n": len(part) // 4})
                    waiting.append(part)
                    held += len(part)
                    at += len(part)
                    if held == size:
                        closed.append(close())
                    if len(closed) == 64:
                        yield pa.RecordBatch.from_pylist(closed, schema=_BLOCK_SCHEMA)
                        closed = []
                start, row = start + total, row + 1
            if closed:
                yield pa.RecordBatch.from_pylist(closed, schema=_BLOCK_SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema=_BLOCK_SCHEMA)

    return write


_BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("first", pa.int64()),
    ("planes", pa.list_(pa.int32())), ("payload", pa.binary()),
    ("slices", pa.list_(pa.struct([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()), ("n", pa.int32()),
    ]))),
])
_PIECE_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
])


def write_ids(documents: DataFrame, path: str, tokenizer_path: str, end_id: int, form: PlaneFormat = PlaneFormat()) -> None:
    """Tokenise ``documents`` (doc_id, text) and write them to the folder ``path`` in ascending order of ``doc_id``."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    # Rows equal in both may stand in any order; the third key lets them be split over ranges.
    keyed = texts.withColumn("tie", F.xxhash64("text")).withColumn("any", F.xxhash64(F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange("doc_id", "tie", "any").sortWithinPartitions("doc_id", "tie")
    blocks = ranged.drop("tie", "any").mapInArrow(_block_writer(tokenizer_path, end_id, form), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("payload", "slices")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, that is per task of the write
    shards = sizes.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n_ids"))
    shards.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("shard_start")).coalesce(
        1
    ).write.parquet(f"{path}/shards")
    starts = spark.read.parquet(f"{path}/shards").select("shard", "shard_start")
    index = sizes.join(starts, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("first")).alias("start"), "n_ids", "planes"
    )
    index.write.parquet(f"{path}/index")


def _block_reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time bounds the memory
                block = batch.slice(i, 1).to_pylist()[0]
                planes, cut = [], 0
                for n in block["planes"]:
                    planes.append(unpress.decompress(block["payload"][cut : cut + n]))
                    cut += n
                data = join_planes(planes, block["n_ids"]).tobytes()
                out, cut = [], 0
                for piece in block["slices"]:
                    ids = data[cut : cut + 4 * piece["n"]]
                    cut += len(ids)
                    out.append(piece | {"shard": block["shard"], "crc": zlib.crc32(ids), "ids": ids if with_ids else None})
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE_SCHEMA)

    return read


def _pieces(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    pieces = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(_block_reader(with_ids), PIECES)
    starts = spark.read.parquet(f"{path}/shards").select("shard", "shard_start")
    return pieces.join(starts, "shard").withColumn("start", F.col("start") + F.col("shard_start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document with its ids, as little-endian unsigned 32-bit integers: ``doc_id, start, n_tokens, ids``."""
    parts = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return (
        _pieces(spark, path, True)
        .groupBy("shard", "row", "doc_id", "start", "n_tokens")
        .agg(F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))
        .select("doc_id", "start", "n_tokens", "ids")
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Every document with the checksum of its ids: ``doc_id, start, n_tokens, ids_crc32``; no id is moved.

    Checksums of the pieces of a document are combined: CRC-32 is affine, so that of two parts follows from the
    parts' own and those of as many zero bytes as the second part has.
    """

    @F.pandas_udf("long")
    def combined(pieces):
        def fold(parts) -> int:
            whole = 0
            for part in sorted(parts, key=lambda p: p["at"]):
                if part["at"] == 0:
                    whole = part["crc"]
                else:
                    zeros = bytes(4 * part["n"])
                    whole = zlib.crc32(zeros, whole) ^ zlib.crc32(zeros) ^ part["crc"]
            return whole

        return pieces.map(fold)

    return (
        _pieces(spark, path, False)
        .groupBy("shard", "row", "doc_id", "start", "n_tokens")
        .agg(F.collect_list(F.struct("at", "n", "crc")).alias("pieces"))
        .select("doc_id", "start", "n_tokens", combined("pieces").alias("ids_crc32"))
    )
