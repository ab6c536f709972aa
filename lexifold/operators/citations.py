"""Checks of a model reply against the context the model was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.functions.answers import is_verbatim, outranks, source_label
from lexifold.functions.text import normalize, unicode_trim

SOURCE_FIELDS = ("source_id", "title", "version", "effective_date", "status", "category", "section_path")


def valid_citations(replies: DataFrame, context: DataFrame) -> DataFrame:
    """Citations of known labels, repeated ones once, in order of first use.

    ``replies``: ``query_id, citations array<label, quote>``; ``context``:
    ``query_id, label, content`` and the source fields.
    """
    cited = replies.select("query_id", F.posexplode("citations").alias("position", "citation")).select(
        "query_id",
        "position",
        source_label(F.col("citation.label")).alias("label"),
        unicode_trim(F.col("citation.quote")).alias("quote"),
    )
    first = cited.groupBy("query_id", "label", "quote").agg(F.min("position").alias("position"))
    known = context.select("query_id", "label", "content", "document_key", *SOURCE_FIELDS)
    return first.join(known, ["query_id", "label"]).select(
        "query_id",
        "position",
        "label",
        "quote",
        is_verbatim(F.col("quote"), normalize(F.col("content"))).alias("quote_verified"),
        "document_key",
        *SOURCE_FIELDS,
    )


def checked_conflicts(replies: DataFrame, context: DataFrame) -> DataFrame:
    """Conflicts whose chosen and at least one other rejected source are known.

    One row per conflict: chosen source, rejected sources in reply order (at
    most one per context label), and whether the choice follows the precedence
    of authority, then recency, over every rejected source.
    """
    told = replies.select("query_id", F.posexplode("conflicts").alias("conflict_no", "conflict")).select(
        "query_id",
        "conflict_no",
        unicode_trim(F.col("conflict.topic")).alias("topic"),
        unicode_trim(F.col("conflict.reason")).alias("reason"),
        source_label(F.col("conflict.chosen")).alias("chosen_label"),
        F.array_distinct(F.transform("conflict.rejected", source_label)).alias("rejected_labels"),
    )
    facts = F.struct("source_id", "version", "effective_date", "category", "section_path")
    known = context.select("query_id", "label", facts.alias("facts"))
    chosen = known.select("query_id", F.col("label").alias("chosen_label"), F.col("facts").alias("chosen"))
    rejected = known.select("query_id", F.col("label").alias("rejected_label"), F.col("facts").alias("rejected"))
    pairs = (
        told.join(chosen, ["query_id", "chosen_label"])
        .select("*", F.posexplode("rejected_labels").alias("rejected_no", "rejected_label"))
        .where(F.col("rejected_label") != F.col("chosen_label"))
        .join(rejected, ["query_id", "rejected_label"])
    )
    wins = outranks(
        F.col("chosen.category"), F.col("chosen.effective_date"),
        F.col("rejected.category"), F.col("rejected.effective_date"),
    )
    grouped = pairs.groupBy("query_id", "conflict_no").agg(
        F.first("topic").alias("topic"),
        F.first("reason").alias("reason"),
        F.first("chosen").alias("chosen"),
        F.array_sort(F.collect_list(F.struct("rejected_no", "rejected"))).alias("numbered"),
        F.bool_and(wins).alias("rule_satisfied"),
    )
    return grouped.select(
        "query_id",
        "conflict_no",
        "topic",
        "reason",
        "chosen",
        F.transform("numbered", lambda entry: entry["rejected"]).alias("rejected"),
        "rule_satisfied",
    )
