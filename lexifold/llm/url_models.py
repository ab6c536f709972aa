"""URL filters: rules by host and path, and for the rest two character models.

URLs that a rule decides are the examples: those allowed train one variable-order Markov model of characters, those
blocked another. Each model mixes the orders 0 to ``order`` by Witten-Bell smoothing, so contexts that were hardly
seen fall back on shorter ones. A URL's score is the difference of the two log-likelihoods by character; it is
allowed if the score reaches a threshold that is calibrated on examples held out from the counts.

Counts cover all examples of the table. Contexts are hashed to ``cells`` cells of each order and class, so the
counts that reach the driver and the tasks have a fixed bound of 2 x (order + 1) x cells x 2 numbers.

Defined results: a null url counts as empty; empty urls and urls without ``://`` have an empty host and path, fit
no rule and score 0 if empty; with no examples of one kind every score is 0 and the verdict is ``allow``; rows of a
null ``page_id`` and repeated rows stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


# The rules of the registered query.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


@dataclass(frozen=True)
class ModelOptions:
    order: int = 4
    cells: int = 1 << 16
    symbols: int = 256
    held_out: int = 5  # one of so many examples calibrates
    bins: int = 2001  # of scores from -10 to 10


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. A rule fits its host and all subdomains."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# --- the models -----------------------------------------------------------------------------------------------------


def cells_of(url: bytes, options: ModelOptions) -> tuple[np.ndarray, np.ndarray]:
    """Of each order, the cells of the contexts before each character, and of these contexts with the character."""
    chars = np.concatenate((np.zeros(options.order, np.uint64), np.frombuffer(url, np.uint8).astype(np.uint64) + np.uint64(1)))
    n = len(url)
    contexts, both = np.zeros((options.order + 1, n), np.int64), np.zeros((options.order + 1, n), np.int64)
    now = chars[options.order :]
    rolled = np.zeros(n, np.uint64)
    for k in range(options.order + 1):
        if k:
            rolled = (rolled + chars[options.order - k : options.order - k + n]) * np.uint64(0x9E3779B97F4A7C15)
        contexts[k] = (rolled >> np.uint64(40)).astype(np.int64) % options.cells
        joint = (rolled + now * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
        both[k] = (joint >> np.uint64(40)).astype(np.int64) % options.cells
    return contexts, both


@dataclass(frozen=True)
class MarkovModel:
    """``seen`` by order and cell of (context, character), ``total`` and ``kinds`` by order and cell of the context."""

    seen: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    options: ModelOptions

    def log_likelihood(self, contexts: np.ndarray, both: np.ndarray) -> float:
        """By character, of a URL's cells: Witten-Bell mixtures from order 0 up, which rest on even odds."""
        p = np.full(contexts.shape[1], 1.0 / self.options.symbols)
        for k in range(len(contexts)):
            n, t, c = self.total[k, contexts[k]], self.kinds[k, contexts[k]], self.seen[k, both[k]]
            p = np.where(n > 0, (np.minimum(c, n) + t * p) / np.maximum(n + t, 1), p)
        return float(np.log(p).mean()) if len(p) else 0.0


def _count(options: ModelOptions):
    """Counts of one task, one row for each cell that is not empty."""
    shape = (2, options.order + 1, options.cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        pairs: set[tuple] = set()
        for batch in batches:
            for url, good in zip(batch.column("url").to_pylist(), batch.column("good").to_pylist(), strict=True):
                contexts, both = cells_of(url.encode(), options)
                for k in range(options.order + 1):
                    np.add.at(total[int(good), k], contexts[k], 1)
                    np.add.at(seen[int(good), k], both[k], 1)
                    pairs.update(zip([(int(good), k)] * len(url.encode()), contexts[k].tolist(), both[k].tolist(), strict=True))
        for part, table in ((0, total), (1, seen)):
            good, k, cell = np.nonzero(table)
            if len(good):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(good), part), pa.int32()), pa.array(good, pa.int32()), pa.array(k, pa.int32()),
                     pa.array(cell, pa.int64()), pa.array(np.zeros(len(good)), pa.int64()), pa.array(table[good, k, cell], pa.int64())],
                    ["part", "good", "k", "cell", "joint", "n"],
                )
        rows = sorted((g, k, a, b) for (g, k), a, b in pairs)
        if rows:
            g, k, a, b = (np.array(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(g), 2), pa.int32()), pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(a, pa.int64()),
                 pa.array(b, pa.int64()), pa.array(np.ones(len(g)), pa.int64())],
                ["part", "good", "k", "cell", "joint", "n"],
            )

    return run


def fit(examples: DataFrame, options: ModelOptions = ModelOptions()) -> tuple[MarkovModel, MarkovModel] | None:
    """Models of blocked and of allowed urls from ``examples`` (url, good); None if one kind is missing."""
    rows = "part int, good int, k int, cell long, joint long, n long"
    counts = examples.select("url", "good").mapInArrow(_count(options), rows).groupBy("part", "good", "k", "cell", "joint").agg(F.sum("n").alias("n"))
    kinds = F.when(F.col("part") == 2, F.lit(1)).otherwise(F.col("n"))
    table = counts.groupBy("part", "good", "k", "cell").agg(F.sum(kinds).alias("n")).toPandas()
    shape = (3, 2, options.order + 1, options.cells)
    dense = np.zeros(shape)
    dense[table["part"], table["good"], table["k"], table["cell"]] = table["n"]
    if not dense[0, 0].any() or not dense[0, 1].any():
        return None
    return tuple(MarkovModel(dense[1, g], dense[0, g], dense[2, g], options) for g in (0, 1))


def score(url: bytes, models: tuple[MarkovModel, MarkovModel] | None) -> float:
    """By character: log-likelihood as an allowed url less that as a blocked one."""
    if models is None:
        return 0.0
    cells = cells_of(url, models[0].options)
    return models[1].log_likelihood(*cells) - models[0].log_likelihood(*cells)


def with_scores(urls: DataFrame, models: tuple[MarkovModel, MarkovModel] | None, column: str = "url") -> DataFrame:
    """``urls`` with the column ``score``."""
    schema = StructType([*urls.schema.fields, StructField("score", DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score((u or "").encode(), models) for u in batch.column(column).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    return urls.mapInArrow(run, schema)


def calibrate(scored: DataFrame, options: ModelOptions = ModelOptions()) -> float:
    """The threshold with the highest mean of the two classes' shares decided rightly, from ``scored`` (good, score)."""
    bin_of = F.least(F.greatest(F.floor((F.col("score") + 10) / 20 * options.bins), F.lit(0)), F.lit(options.bins - 1))
    counts = scored.groupBy("good", bin_of.cast("int").alias("bin")).count().collect()  # at most twice ``bins`` rows
    table = np.zeros((2, options.bins))
    for row in counts:
        table[int(row["good"]), row["bin"]] = row["count"]
    if not table.sum(1).all():
        return 0.0
    share = table / table.sum(1, keepdims=True)
    right = np.concatenate(([0.0], np.cumsum(share[0]))) + np.concatenate((np.cumsum(share[1][::-1])[::-1], [0.0]))
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] / options.bins * 20 - 10)


def judge(pages: DataFrame, rules: tuple = RULES, options: ModelOptions = ModelOptions()) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages`` (page_id, url)."""
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("by_rule", decide(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("by_rule.rule").alias("rule"), F.col("by_rule.verdict").alias("ruled"))
    examples = rows.where("rule is not null").select("url", (F.col("ruled") == "allow").alias("good"))
    apart = F.pmod(F.xxhash64("url"), F.lit(options.held_out)) == 0
    models = fit(examples.where(~apart), options)
    threshold = calibrate(with_scores(examples.where(apart), models).select("good", "score"), options) if models else 0.0
    scored = with_scores(rows, models)
    by_model = F.when((F.col("score") >= threshold) | (F.col("url") == ""), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
