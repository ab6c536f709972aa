"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEXICAL_LIST, DENSE_LIST = 0, 1


def fuse(ranked: DataFrame, item: tuple[str, ...], rrf_k: int, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``per, list_no, rank, item`` -> ``per, rank, item, fused_score``; equal scores keep first-seen order."""
    fused = ranked.groupBy(*per, *item).agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("fused_score"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
    )
    window = Window.partitionBy(*per).orderBy(F.desc("fused_score"), "first_seen")
    return fused.select(*per, F.row_number().over(window).alias("rank"), *item, "fused_score")
