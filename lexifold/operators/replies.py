"""A ledger of model replies: what was asked once is not asked, or paid for, again.

A call is known by the hash of model, system text and prompt. Prompts without a
reply go in *waves*: each wave is a job of ``parallel_calls`` tasks with about
``calls_per_commit`` prompts each, and is appended to the ledger before the
next starts. A lost task repeats its prompts of one wave only; a job that is
started anew repeats at most the wave that was under way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators.models import GENERATED_SCHEMA, REPLY_COLUMNS, SYSTEM_INSTRUCTION, GenerateFn, asker, spread_calls
from lexifold.sources.scratch import materialize

LEDGER_COLUMNS = f"call_key string, run string, {GENERATED_SCHEMA}"
_KEY_DIGITS = 8


@dataclass(frozen=True)
class ReplyLedger:
    """``path``: a folder that every executor reaches; ``model``: what the generator calls, part of the key."""

    path: str
    model: str
    calls_per_commit: int = 32


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """All calls of all runs, failed ones included; no rows where nothing was ever asked."""
    try:
        return spark.read.schema(LEDGER_COLUMNS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_COLUMNS)


def call_key(model: str, system: str, prompt: Column) -> Column:
    """Hashes of fixed length before the prompt, so no two calls share a key by where one part ends."""
    return F.sha2(F.concat(F.sha2(F.lit(model), 256), F.sha2(F.lit(system), 256), prompt), 256)


def _wave_bounds(waves: int) -> list[Column]:
    """Filters that split the keys evenly; on a table sorted by key they skip the files of all other waves."""
    edges = [f"{(n << 4 * _KEY_DIGITS) // waves:0{_KEY_DIGITS}x}" for n in range(waves)]
    return [
        (F.col("call_key") >= low) & (F.col("call_key") < high if high else F.lit(True))
        for low, high in zip(edges, [*edges[1:], None], strict=True)
    ]


def _ask_wave(unseen: DataFrame, generate: GenerateFn, system: str, run: str, parallel_calls: int) -> DataFrame:
    ask = asker(generate, system)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            answered = pd.DataFrame([ask(p) for p in frame["prompt"]], columns=REPLY_COLUMNS, dtype=object)
            answered.insert(0, "call_key", frame["call_key"].to_numpy())
            answered.insert(1, "run", run)
            yield answered

    return spread_calls(unseen, parallel_calls).mapInPandas(call, LEDGER_COLUMNS)


def answers_with_ledger(
    prompts: DataFrame, generate: GenerateFn, ledger: ReplyLedger, system: str = SYSTEM_INSTRUCTION, parallel_calls: int | None = None
) -> DataFrame:
    """As ``generate_answers``, and ``kept``: the reply is from an earlier run. Kept replies took no time (``latency_ms`` 0).

    Equal prompts are asked once. Only replies are kept: a call that failed is made again by the next run. A null
    prompt counts as empty.
    """
    spark = prompts.sparkSession
    run = uuid.uuid4().hex
    tasks = parallel_calls or spark.sparkContext.defaultParallelism
    prompt = F.coalesce("prompt", F.lit(""))
    asked = materialize(prompts.select("query_id", call_key(ledger.model, system, prompt).alias("call_key"), prompt.alias("prompt")), "prompts")

    known = read_replies(spark, ledger.path).where(F.col("failure").isNull()).select("call_key")
    one_each = asked.groupBy("call_key").agg(F.first("prompt").alias("prompt"))
    unseen = materialize(one_each.join(known, "call_key", "left_anti").orderBy("call_key"), "unseen-prompts")
    n_unseen = unseen.count()
    if n_unseen:
        for wave in _wave_bounds(-(-n_unseen // (tasks * ledger.calls_per_commit))):
            _ask_wave(unseen.where(wave), generate, system, run, tasks).write.mode("append").parquet(ledger.path)

    # Two runs at a time may have asked the same; any reply will do, but all queries of a prompt take the same.
    found = read_replies(spark, ledger.path).where(F.col("failure").isNull() | (F.col("run") == run))
    found = found.join(asked.select("call_key").distinct(), "call_key", "left_semi")
    fields = ["run", *REPLY_COLUMNS]
    one = found.groupBy("call_key").agg(F.min(F.struct(F.col("failure").isNotNull().alias("failed"), *fields)).alias("call"))
    kept = F.col("call.run") != run
    return asked.join(one, "call_key").select(
        "query_id",
        *[F.col(f"call.{c}").alias(c) for c in REPLY_COLUMNS[:-1]],
        F.when(kept, F.lit(0).cast("long")).otherwise(F.col("call.latency_ms")).alias("latency_ms"),
        kept.alias("kept"),
    )
