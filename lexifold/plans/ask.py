"""Batch question answering: retrieve, gate, resolve versions, generate, validate, report."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions.answers import clean_answer, parse_reply, prompt_text
from lexifold.functions.text import unicode_trim
from lexifold.operators.citations import checked_conflicts, valid_citations
from lexifold.operators.models import EmbedFn, GenerateFn, generate_answers
from lexifold.operators.replies import ReplyLedger, answers_with_ledger
from lexifold.operators.validation import enough_evidence, refusal_reason, validate_questions
from lexifold.operators.versioning import Resolution, resolve_versions
from lexifold.options import DEFAULTS, EmbeddingOptions, RetrievalOptions
from lexifold.plans.index import KnowledgeIndex
from lexifold.plans.search import PreparedQueries, prepare, require_unique, search, search_within_documents, with_chunks
from lexifold.sources.scratch import materialize

# Texts that are part of every response.
NOT_ENOUGH_INFORMATION = "Bu soruyu yanıtlamak için dokümanlarda yeterli bilgi bulunamadı."
VERSION_RULE = (
    "Aynı doküman ailesinde, yürürlük tarihi bugün veya daha önce olan en yeni sürüm seçilir; "
    "'superseded' işaretli sürüm seçilmez."
)

CITED, RETRIEVED = "cited", "retrieved"


@dataclass(frozen=True)
class AskContext:
    """What the generator is given, and why.

    ``retrieval``: per query ``mode, max_dense, max_coverage, evidence``;
    ``hits``: candidates before version resolution; ``context``: labelled
    chunks; ``prompts``: one row per query that passed the evidence gate.
    """

    retrieval: DataFrame
    hits: DataFrame
    resolution: Resolution
    context: DataFrame
    prompts: DataFrame


def merge_substitutes(kept: DataFrame, substitutes: DataFrame, top_k: int) -> DataFrame:
    """Kept hits in retrieval order, with substitutes at the place of the hit they replace; labelled and cut.

    ``kept``: ``query_id, rank, doc_no, chunk_order``; ``substitutes``: the same and ``replaced_rank``.
    """
    merged = kept.select("query_id", F.col("rank").alias("place"), F.lit(0).alias("turn"), "doc_no", "chunk_order").unionByName(
        substitutes.select("query_id", F.col("replaced_rank").alias("place"), F.col("rank").alias("turn"), "doc_no", "chunk_order")
    )
    window = Window.partitionBy("query_id").orderBy("place", "turn")
    return (
        merged.withColumn("position", F.row_number().over(window))
        .where(F.col("position") <= top_k)
        .select("query_id", "position", F.concat(F.lit("C"), "position").alias("label"), "doc_no", "chunk_order")
    )


def build_context(
    index: KnowledgeIndex, prepared: PreparedQueries, as_of: datetime.date | None, options: RetrievalOptions = DEFAULTS
) -> AskContext:
    """Twice ``top_k`` candidates are fetched, as outdated versions fall away before the cut.

    Versions are resolved on the day ``as_of``, or without one on each question's own day, the column ``as_of`` of the queries.
    """
    result = search(index, prepared, top_k=2 * options.top_k, options=options)
    evidence = enough_evidence(F.col("mode"), F.col("max_dense"), F.col("max_coverage"), options)
    retrieval = materialize(result.stats.withColumn("evidence", evidence), "retrieval")
    hits = result.hits.join(index.versions, "doc_no")
    if as_of is None:
        hits = hits.join(prepared.queries.select("query_id", "as_of"), "query_id")
    hits = materialize(hits, "hits")

    answerable = retrieval.where("evidence").select("query_id")
    resolution = Resolution(
        materialize(resolve_versions(hits.join(answerable, "query_id", "left_semi"), index.versions, as_of).hits, "resolution")
    )
    wanted = resolution.needs_substitution.join(index.versions.select("source_id", "doc_no"), "source_id").select(
        "query_id", "doc_no", "replaced_rank"
    )
    substitutes = search_within_documents(
        index, prepared, wanted.select("query_id", "doc_no"), options.substitute_sections, options, resolution.hits.count()
    ).join(wanted, ["query_id", "doc_no"])
    placed = merge_substitutes(resolution.kept, substitutes, options.top_k)
    context = materialize(with_chunks(index, placed, options), "context")

    facts = ("position", "label", "title", "version", "effective_date", "category", "section_path", "content")
    sources = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*facts))).alias("sources"))
    # A question whose hits were all discarded is still asked, with an empty context.
    no_sources = F.array().cast(sources.schema["sources"].dataType)
    prompts = (
        prepared.queries.select("query_id", "text")
        .join(answerable, "query_id", "left_semi")
        .join(sources, "query_id", "left")
        .select("query_id", prompt_text(F.col("text"), F.coalesce("sources", no_sources)).alias("prompt"))
    )
    return AskContext(retrieval, hits, resolution, context, prompts)


def version_report(resolution: Resolution, cited: DataFrame | None = None) -> DataFrame:
    """Selected and discarded versions, one row each, in order of first appearance.

    With ``cited`` (``query_id, document_key``) only families the answer cites are reported.
    """
    selected = resolution.selected.select(
        "query_id", F.lit("selected").alias("kind"), "first_rank", "document_key", "source_id", "title", "version",
        "effective_date", F.lit(None).cast("string").alias("reason"),
    )
    discarded = resolution.discarded.select(
        "query_id", F.lit("discarded").alias("kind"), "first_rank", "document_key", "source_id", "title", "version",
        "effective_date", "reason",
    )
    report = selected.unionByName(discarded)
    if cited is None:
        return report
    return report.join(cited.select("query_id", "document_key").distinct(), ["query_id", "document_key"], "left_semi").select(
        *report.columns
    )


@dataclass(frozen=True)
class ValidatedAnswers:
    """``answers``: one row per reply; ``citations`` and ``conflicts``: their checked details."""

    answers: DataFrame
    citations: DataFrame
    conflicts: DataFrame


def validate_answers(replies: DataFrame, context: DataFrame, strip_cited_quotes: bool = True) -> ValidatedAnswers:
    """``query_id, reply`` against the labelled context.

    A reply that cannot be parsed has ``valid`` false. Quoted copies of cited
    text are removed from the answer unless ``strip_cited_quotes`` is false.
    """
    parsed = materialize(replies.select("query_id", parse_reply(F.col("reply")).alias("parsed")).select("query_id", "parsed.*"), "parsed")
    citations = materialize(valid_citations(parsed.where("answerable"), context), "citations")
    conflicts = materialize(checked_conflicts(parsed.where("answerable"), context), "conflicts")
    quotes = citations.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_citations"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "quote"))), lambda c: c["quote"]).alias("quotes"),
    )
    joined = parsed.join(quotes, "query_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    no_quotes = F.array().cast("array<string>")
    answer = clean_answer(F.col("answer"), F.coalesce("quotes", no_quotes) if strip_cited_quotes else None)
    reason = refusal_reason(F.lit(True), F.col("answerable"), F.col("n_citations"))
    answers = joined.withColumn("refusal_reason", reason).select(
        "query_id",
        "valid",
        (F.col("refusal_reason") == "").alias("answerable"),
        F.when(F.col("refusal_reason") == "", answer).otherwise(NOT_ENOUGH_INFORMATION).alias("answer"),
        unicode_trim(F.col("missing_information")).alias("missing_information"),
        "refusal_reason",
    )
    answered = answers.where("answerable").select("query_id")
    return ValidatedAnswers(
        answers,
        citations.join(answered, "query_id", "left_semi"),
        conflicts.join(answered, "query_id", "left_semi"),
    )


def _listed(rows: DataFrame, order: tuple[str, ...], entry, name: str) -> DataFrame:
    """One array per query; every source of rows here is bounded by the context or the reply of a query."""
    keyed = F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry"))))
    return rows.groupBy("query_id").agg(F.transform(keyed, lambda r: r["entry"]).alias(name))


def _scoped_report(resolution: Resolution, outcome: ValidatedAnswers, scope: str) -> DataFrame:
    """Versions of the cited families for answered questions; of all retrieved families for refused ones."""
    report = version_report(resolution)
    if scope == RETRIEVED:
        return report
    refused = outcome.answers.where("valid and not answerable").select("query_id")
    cited = version_report(resolution, outcome.citations.select("query_id", "document_key"))
    return cited.unionByName(report.join(refused, "query_id", "left_semi").select(*cited.columns))


def _refused_outright(checked: DataFrame) -> DataFrame:
    """Responses to questions that cannot be asked at all, shaped like the others."""
    return checked.select("query_id", F.col("text").alias("question"), "status", "message_code", F.lit(False).alias("answerable"))


def answer_questions(
    index: KnowledgeIndex | None,
    questions: DataFrame,
    generate: GenerateFn,
    as_of: datetime.date | None,
    embed: EmbedFn | None = None,
    embedding: EmbeddingOptions | None = None,
    report_scope: str = CITED,
    strip_cited_quotes: bool = True,
    options: RetrievalOptions = DEFAULTS,
    parallel_calls: int | None = None,
    ledger: ReplyLedger | None = None,
) -> DataFrame:
    """One row per question: status, answer or refusal, and the whole response as JSON.

    ``as_of``: the day for all questions, or None for each question's own (column ``as_of``), as when logged questions
    of many days are asked again.

    ``status``: 200 answered or refused, 400 invalid question, 503 no index
    (then only the first columns are there) or generator unavailable, 502 reply
    unusable. ``report_scope`` decides whether version resolution is reported
    for the cited families of an answer or for all retrieved ones; a refusal
    always reports all. ``latency_ms`` is the time of the batch's retrieval,
    for which every question waits, and of the question's own model call. With a
    ``ledger``, replies are kept as they come and a prompt that has one is not
    asked again.
    """
    checked = validate_questions(require_unique(questions), index is not None, options)
    if index is None:
        return _refused_outright(checked)
    started = time.monotonic()
    valid = questions.drop("text").join(checked.where(F.col("status") == 200).select("query_id", "text"), "query_id")
    prepared = prepare(index, valid, embed, embedding)
    asked = build_context(index, prepared, as_of, options)
    retrieval_ms = int((time.monotonic() - started) * 1000)
    if ledger is None:
        generated = generate_answers(asked.prompts, generate, parallel_calls=parallel_calls)
    else:
        generated = answers_with_ledger(asked.prompts, generate, ledger, parallel_calls=parallel_calls)
    generated = materialize(generated.withColumn("latency_ms", F.col("latency_ms") + F.lit(retrieval_ms)), "generated")
    outcome = validate_answers(
        generated.where(F.col("failure").isNull()).select("query_id", "reply"), asked.context, strip_cited_quotes
    )
    report = materialize(_scoped_report(asked.resolution, outcome, report_scope), "report")

    date = F.date_format("effective_date", "yyyy-MM-dd").alias("effectiveDate")
    version_ref = (F.col("source_id").alias("documentId"), F.col("title"), F.col("version"), date)
    sources = _listed(
        outcome.citations,
        ("position",),
        F.struct(*version_ref, "status", "category", F.col("section_path").alias("section"), "quote", F.col("quote_verified").alias("quoteVerified")),
        "sources",
    )

    def conflict_source(s):
        return F.struct(
            s["source_id"].alias("documentId"), s["version"].alias("version"),
            F.date_format(s["effective_date"], "yyyy-MM-dd").alias("effectiveDate"),
            s["category"].alias("category"), s["section_path"].alias("section"),
        )

    conflicts = _listed(
        outcome.conflicts,
        ("conflict_no",),
        F.struct(
            "topic", conflict_source(F.col("chosen")).alias("chosen"),
            F.transform("rejected", conflict_source).alias("rejected"),
            "reason", F.col("rule_satisfied").alias("ruleSatisfied"),
        ),
        "conflicts",
    )
    selected = _listed(report.where(F.col("kind") == "selected"), ("first_rank", "source_id"), F.struct(*version_ref), "selected")
    discarded = _listed(
        report.where(F.col("kind") == "discarded"), ("first_rank", "source_id"), F.struct(*version_ref, "reason"), "discarded"
    )
    first_met = asked.hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("first_rank"))
    candidates = _listed(first_met, ("first_rank",), F.col("source_id"), "candidates")
    labels = _listed(
        asked.context,
        ("position",),
        F.struct("label", F.col("source_id").alias("documentId"), "version", F.col("section_path").alias("section")),
        "labels",
    )

    joined = checked.select("query_id", F.col("text").alias("question"), F.col("status").alias("input_status"), F.col("message_code").alias("input_code"))
    for part in (
        asked.retrieval,
        generated.select("query_id", "model", "failure", "input_tokens", "output_tokens", "latency_ms"),
        outcome.answers.withColumnRenamed("refusal_reason", "late_refusal"),
        sources, conflicts, selected, discarded, candidates, labels,
    ):
        joined = joined.join(part, "query_id", "left")

    status = (
        F.when(F.col("input_status") != 200, F.col("input_status"))
        .when(F.col("failure") == "unavailable", 503)
        .when((F.col("failure") == "invalid_output") | ~F.col("valid"), 502)
        .otherwise(200)
    )
    message = (
        F.when(F.col("input_status") != 200, F.col("input_code"))
        .when(status == 503, "generator_unavailable")
        .when(status == 502, "reply_invalid")
    )
    reason = F.when(status == 200, F.when(~F.col("evidence"), "LowRelevance").otherwise(F.col("late_refusal")))

    latency = F.coalesce("latency_ms", F.when(F.col("input_status") == 200, F.lit(retrieval_ms)).otherwise(0)).cast("bigint")

    def listed(name: str):
        return F.coalesce(name, F.array().cast(joined.schema[name].dataType))

    shaped = joined.select(
        "query_id",
        "question",
        status.alias("status"),
        message.alias("message_code"),
        (F.coalesce(reason, F.lit("-")) == "").alias("answerable"),
        F.when(status == 200, F.when(F.col("evidence"), F.col("answer")).otherwise(NOT_ENOUGH_INFORMATION)).alias("answer"),
        listed("sources").alias("sources"),
        F.struct(
            (F.size(listed("discarded")) > 0).alias("applied"), F.lit(VERSION_RULE).alias("rule"),
            listed("selected").alias("selected"), listed("discarded").alias("discarded"),
        ).alias("version_resolution"),
        listed("conflicts").alias("conflicts"),
        F.coalesce("missing_information", F.lit("")).alias("missing_information"),
        reason.alias("refusal_reason"),
        F.coalesce("model", F.lit("")).alias("model"),
        latency.alias("latency_ms"),
        F.struct(
            F.col("mode").alias("retrievalMode"), F.col("max_dense").alias("maxDenseScore"),
            F.col("max_coverage").alias("maxLexicalCoverage"), listed("candidates").alias("candidateDocumentIds"),
            listed("labels").alias("context"), F.coalesce("model", F.lit("")).alias("model"),
            latency.alias("latencyMs"),
            F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"),
        ).alias("diagnostics"),
    )
    response = F.struct(
        "question", "answerable", "answer", "sources", F.col("version_resolution").alias("versionResolution"), "conflicts",
        F.col("missing_information").alias("missingInformation"), F.col("refusal_reason").alias("refusalReason"), "diagnostics",
    )
    return shaped.withColumn("response_json", F.when(F.col("status") == 200, F.to_json(response, {"ignoreNullFields": "false"})))


