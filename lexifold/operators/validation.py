"""Checks of incoming queries and questions, and the evidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions.text import unicode_trim, utf16_length
from lexifold.options import DEFAULTS, RetrievalOptions

LOW_RELEVANCE = "LowRelevance"
INSUFFICIENT_CONTEXT = "ModelInsufficientContext"
NO_VALID_CITATIONS = "NoValidCitations"


def _first_failure(failures: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    status, code = F.lit(200), F.lit(None).cast("string")
    for failed, number, name in reversed(failures):
        status, code = F.when(failed, number).otherwise(status), F.when(failed, name).otherwise(code)
    return status, code


def validate_queries(queries: DataFrame, index_ready: bool = True, options: RetrievalOptions = DEFAULTS) -> DataFrame:
    """``query_id, text, top_k`` -> trimmed text, effective top_k, ``status`` and ``message_code`` (null when valid)."""
    text = F.coalesce(unicode_trim(F.col("text")), F.lit(""))
    top_k = F.coalesce(F.col("top_k"), F.lit(options.top_k))
    status, code = _first_failure(
        [
            (text == "", 400, "query_required"),
            (utf16_length(text) > options.max_query_chars, 400, "query_too_long"),
            (~top_k.between(1, options.max_top_k), 400, "top_k_out_of_range"),
            (F.lit(not index_ready), 503, "index_not_ready"),
        ]
    )
    return queries.select(
        "query_id", text.alias("text"), top_k.cast("int").alias("top_k"), status.alias("status"), code.alias("message_code")
    )


def validate_questions(questions: DataFrame, index_ready: bool = True, options: RetrievalOptions = DEFAULTS) -> DataFrame:
    text = F.coalesce(unicode_trim(F.col("text")), F.lit(""))
    status, code = _first_failure(
        [
            (text == "", 400, "question_required"),
            (utf16_length(text) > options.max_query_chars, 400, "question_too_long"),
            (F.lit(not index_ready), 503, "index_not_ready"),
        ]
    )
    return questions.select("query_id", text.alias("text"), status.alias("status"), code.alias("message_code"))


def enough_evidence(mode: Column, max_dense: Column, max_coverage: Column, options: RetrievalOptions = DEFAULTS) -> Column:
    return ((mode == "hybrid") & (max_dense >= options.min_dense_score)) | (max_coverage >= options.min_lexical_coverage)


def refusal_reason(evidence: Column, answerable: Column, valid_citations: Column) -> Column:
    """Empty when answered; otherwise the first gate that withheld the answer."""
    return (
        F.when(~evidence, LOW_RELEVANCE)
        .when(~answerable, INSUFFICIENT_CONTEXT)
        .when(valid_citations == 0, NO_VALID_CITATIONS)
        .otherwise("")
    )
