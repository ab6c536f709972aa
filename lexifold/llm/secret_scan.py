"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed: its *blob* is the SHA-256 of its text. The ledger is a table
(blob, rules, spans) in a folder, one part per scan, and says which blob was scanned by which version of the rules. A
scan takes only pairs that the ledger does not have, each text once however many paths and versions hold it, and
appends them, also those without a finding. Findings are joined back to all paths by blob.

Texts are deduplicated inside each task before they are shuffled by blob, so a blob that a third of all rows share
arrives once per task of the scan, not once per row.

Defined results: null text counts as empty; empty texts have no findings; rows of a null path and repeated rows
stay; an empty table gives an empty table; the ledger of a folder that does not exist is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.llm.bitmap import may_be_in

LEDGER = "blob binary, rules string, spans array<struct<kind:string,start:long,stop:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` over the text; matches whose group ``group`` has fewer than ``least`` characters are dropped.

    ``hints``: lower-case strings of which a text must hold one, in either case, for the rule to match at all.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple = ()
    flags: int = re.ASCII


# The three base rules, in the order that settles ties.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?", hints=("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyj",)),
    Rule("prefixed_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", hints=("gh", "xox", "sk_live_")),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: tuple) -> str:
    """A name that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, stop)`` in code points, by start, then in the order of the rules."""
    low, found = text.lower(), []
    for i, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in re.finditer(rule.pattern, text, rule.flags):
            a, b = m.span(rule.group)
            if b - a >= rule.least:
                found.append((m.start(), i, m.end()))
    return [(rules[i].kind, a, b) for a, i, b in sorted(found)]


def versions(table: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path, blob, text`` of every row of a table of versions."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    return table.select(F.col(path).alias("path"), F.unhex(F.sha2(text_of, 256)).alias("blob"), text_of.alias("text"))


def read_ledger(spark: SparkSession, folder: str, rules: tuple = RULES) -> DataFrame:
    """What the ledger in ``folder`` has of these rules: ``blob, spans``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        ledger = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)
    else:
        ledger = spark.createDataFrame([], LEDGER)
    return ledger.where(F.col("rules") == rules_version(rules)).select("blob", "spans")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each blob that a task meets."""
    seen: set[bytes] = set()
    for batch in batches:
        take = []
        for i, blob in enumerate(batch.column("blob").to_pylist()):
            if blob not in seen:
                seen.add(blob)
                take.append(i)
        yield batch.take(pa.array(take, pa.int64()))


def _scan(rules: tuple):
    name = rules_version(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):
            spans = [
                [{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text, rules)] for text in batch.column("text").to_pylist()
            ]
            names = pa.array([name] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("blob"), names, pa.array(spans, kind)], ["blob", "rules", "spans"])

    return run


def scan(table: DataFrame, folder: str, rules: tuple = RULES) -> None:
    """Scan the blobs of ``versions(...)`` that the ledger in ``folder`` lacks for these rules, and add them to it.

    Rows go to a new part of the folder, committed by Spark's writer; an interrupted scan adds nothing that counts
    twice, as the next one asks the ledger again.
    """
    import uuid

    known = read_ledger(table.sparkSession, folder, rules).select("blob")
    new = table.select("blob", "text").mapInArrow(_once, "blob binary, text string").repartition("blob")
    unseen = new.join(known, "blob", "left_anti").select("blob", "text")
    unseen.mapInArrow(_scan(rules), LEDGER).write.parquet(f"{folder}/part-of-ledger-{uuid.uuid4().hex[:12]}")


def findings(table: DataFrame, folder: str, rules: tuple = RULES) -> DataFrame:
    """Every row of ``versions(...)`` with the spans of its blob: ``path, blob, spans`` (empty without a finding)."""
    found = read_ledger(table.sparkSession, folder, rules).where(F.size("spans") > 0).dropDuplicates(["blob"])
    rows = table.select("path", "blob").join(found, "blob", "left")
    return rows.select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:long,stop:long>>")).alias("spans"))


def describe(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, or overlapping group of spans, replaced by ``mask``."""

    def step(at, span):
        gap = F.substr(text, (at["stop"] + 1).cast("int"), F.greatest(span["start"] - at["stop"], F.lit(0)).cast("int"))
        fresh = span["start"] >= at["stop"]
        return F.struct(
            F.when(fresh, F.concat(at["out"], gap, F.lit(mask))).otherwise(at["out"]).alias("out"),
            F.greatest(at["stop"], span["stop"]).alias("stop"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("stop"))
    return F.aggregate(spans, begin, step, lambda at: F.concat(at["out"], F.substr(text, (at["stop"] + 1).cast("int"))))


def redact_all(documents: DataFrame, folder: str, rules: tuple = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``documents`` (text and any others) with the secrets that the ledger has of each text masked.

    Where a text changes and there is a column ``n_chars``, that is its new length. Only texts that may have a
    finding, told by a bitmap, are joined to it, so all others are not shuffled; null texts stay null.
    """
    found = read_ledger(documents.sparkSession, folder, rules).where(F.size("spans") > 0).dropDuplicates(["blob"])
    # The rows travel as one struct, so no column of theirs can clash with the helper's.
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), blob.alias("blob"))
    maybe = may_be_in(found.select(F.xxhash64("blob")), F.xxhash64("blob"))
    met = rows.where(~maybe).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    joined = met.unionByName(rows.where(maybe).join(found, "blob", "left")).select("row", F.when(F.col("spans").isNotNull(), redact(F.col("row.text"), F.col("spans"), mask)).alias("masked"))
    changed = {"text": F.coalesce("masked", "row.text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked").cast(kind)).otherwise(F.col("row.n_chars"))
    return joined.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
