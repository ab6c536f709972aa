"""One query per operation. Index tables are built once per session and data folder and shared."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import answers as answer_functions
from lexifold.functions.text import embedding_text, normalize, tokens
from lexifold.functions.vectors import cosine_similarity, stable, unit_length
from lexifold.functions.versions import version_key
from lexifold.operators import bm25
from lexifold.operators.cells import build_cells, nearest_in_cells
from lexifold.operators.chunking import addressed_sections, heading_sections
from lexifold.operators.dense import dense_scores, nearest_chunks
from lexifold.operators.models import embed_texts
from lexifold.operators.replies import ReplyLedger, answers_with_ledger
from lexifold.operators.reconcile import action_counts, duplicate_ids, embedding_pending, reconcile
from lexifold.operators.validation import enough_evidence, validate_queries
from lexifold.operators.versioning import current_versions
from lexifold.options import DEFAULTS, EmbeddingOptions
from lexifold.plans import ask
from lexifold.plans.catalog import document_detail, document_versions, list_documents, look_up, status
from lexifold.plans.index import KnowledgeIndex, build_index, vectors_usable
from lexifold.plans.ingest import ingest
from lexifold.plans.search import prepare, search, search_requests, with_chunks
from lexifold.plans.segments import update_index
from lexifold.sources.audit_log import append_audit_log, read_audit_log
from lexifold.sources.markdown import parse_markdown, read_markdown_folder, split_front_matter, write_markdown_folder
from lexifold.sources.scratch import materialize, new_folder
from lexifold.sources.store import Store, StoreChanges, documents_with_chunks, write_changes, write_store
from workload import views
from workload.views import AS_OF, MODEL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


class Workbench:
    """What several queries start from, written once to shared tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def index(self):
        return build_index(views.kb_store(self.spark, self.sf_dir), model=MODEL)

    @cached_property
    def lexical_queries(self):
        return prepare(self.index, views.kb_queries(self.spark, self.sf_dir).drop("vector"))

    @cached_property
    def hybrid_queries(self):
        return prepare(self.index, views.kb_queries(self.spark, self.sf_dir))

    @cached_property
    def lexical(self):
        return search(self.index, self.lexical_queries)

    @cached_property
    def hybrid(self):
        return search(self.index, self.hybrid_queries)

    @cached_property
    def updated_index(self):
        """The index of a former state of the store, and a segment with what changed since."""
        store = views.kb_store(self.spark, self.sf_dir)
        before, changed = views.kb_earlier_store(self.spark, self.sf_dir, store)
        return update_index(build_index(before, model=MODEL), store, changed, model=MODEL)

    @cached_property
    def asked(self):
        return ask.build_context(self.index, self.hybrid_queries, AS_OF)

    @cached_property
    def asked_on_own_days(self):
        """Every question on a day of its own."""
        queries = views.kb_queries(self.spark, self.sf_dir).withColumn("as_of", F.expr(views.OWN_DAY_SQL))
        return ask.build_context(self.index, prepare(self.index, queries), None)

    @cached_property
    def answers(self):
        asked = views.kb_queries(self.spark, self.sf_dir)
        unfit = self.spark.createDataFrame([(-1, " \n "), (-2, "x" * 501)], "query_id bigint, text string")
        return ask.answer_questions(self.index, asked.unionByName(unfit, allowMissingColumns=True), quote_first_line, AS_OF)

    @cached_property
    def validated(self):
        return ask.validate_answers(views.kb_replies(self.asked.context), self.asked.context)

    def scored(self) -> DataFrame:
        prepared = self.lexical_queries
        scored = bm25.score_matches(
            self.index.postings, prepared.terms, self.index.average_length,
            n_terms=prepared.n_terms,
        )
        return self.with_source(scored)

    def with_source(self, rows: DataFrame) -> DataFrame:
        """Document ids in place of document numbers."""
        return rows.join(self.index.versions.select("doc_no", "source_id"), "doc_no").drop("doc_no")


_BENCHES: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, sf_dir: str) -> Workbench:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BENCHES:
        _BENCHES[key] = Workbench(spark, sf_dir)
    return _BENCHES[key]


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- sources -------------------------------------------------------------------------------------


@query
def s1_folder_scan(spark, sf_dir):
    """All documents as files of a folder, and what a scan of the folder finds."""
    folder = new_folder(spark, "markdown")
    write_markdown_folder(views.kb_files(spark, sf_dir, faulty=False), folder)
    return read_markdown_folder(spark, folder).select("file_name", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def s8_audit_log(spark, sf_dir):
    """The log of a batch that was appended twice, with the fields of its responses."""
    path = new_folder(spark, "audit-log")
    answers = workbench(spark, sf_dir).answers
    for _ in range(2):
        append_audit_log(answers, path, batch_id="batch")
    schema = answers.drop("response_json").select(
        "question", "answerable", "answer", "sources", F.col("version_resolution").alias("versionResolution"), F.col("refusal_reason").alias("refusalReason"), "diagnostics"
    ).schema
    logged = read_audit_log(spark, path).withColumn("r", F.from_json("response_json", schema))

    def listed(items, field: str):
        return F.array_join(F.transform(items, lambda i: i[field]), ",")

    return logged.select(
        "query_id", F.md5("question").alias("question_md5"), (F.col("question") == F.col("r.question")).alias("same_question"), "answerable",
        "refusal_reason", F.col("r.answerable").alias("json_answerable"), F.col("r.answer").alias("json_answer"), F.col("r.refusalReason").alias("json_reason"),
        listed(F.col("r.sources"), "documentId").alias("source_ids"), F.size("r.versionResolution.selected").cast("bigint").alias("n_selected"),
        F.size("r.versionResolution.discarded").cast("bigint").alias("n_discarded"), F.col("r.diagnostics.retrievalMode").alias("mode"),
        F.array_join("r.diagnostics.candidateDocumentIds", ",").alias("candidates"), listed(F.col("r.diagnostics.context"), "documentId").alias("context_ids"),
    )


@query
def s2_front_matter(spark, sf_dir):
    split = split_front_matter(views.kb_files(spark, sf_dir, faulty=True))
    return split.select(
        "file_name", F.col("header").isNotNull().alias("well_delimited"),
        F.md5(F.coalesce("header", F.lit(""))).alias("header_md5"), F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"),
    )


@query
def s4_validation(spark, sf_dir):
    parsed = parse_markdown(views.kb_files(spark, sf_dir, faulty=True))
    return parsed.select(
        "file_name", "source_id", "document_key", "title", "version", "effective_date", "status", "category", "supersedes", "error"
    )


@query
def s5_content_hash(spark, sf_dir):
    return parse_markdown(views.kb_files(spark, sf_dir, faulty=True)).select("file_name", "content_hash")


def _plain_store(spark, sf_dir) -> Store:
    chunks = views.kb_chunks(spark, sf_dir).select(
        "*", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model")
    )
    return Store(views.document_rows(views.kb_documents(spark, sf_dir)), chunks)


@query
def s6_documents_with_chunks(spark, sf_dir):
    rows = documents_with_chunks(_plain_store(spark, sf_dir))
    return rows.select(
        "source_id", "title", "version", F.col("chunk_order").cast("bigint").alias("chunk_order"), "section_path",
        F.md5("content").alias("content_md5"),
    )


@query
def s7_next_store(spark, sf_dir):
    """The store after an ingest, written as its next version and read again."""
    files = views.kb_files(spark, sf_dir, faulty=False)
    hashes = materialize(parse_markdown(files).select("source_id", "content_hash"), "hashes")
    stored = write_store(ingest(files, views.kb_stored_before(spark, sf_dir, hashes)).store, new_folder(spark, "store"))
    sections = stored.chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return stored.documents.join(sections, "source_id", "left").select(
        "source_id", "file_name", "content_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


@query
def s7_store_changes(spark, sf_dir):
    """The next store as a segment beside the former ones: what it holds, and which documents were written again."""
    files = views.kb_files(spark, sf_dir, faulty=False)
    hashes = materialize(parse_markdown(files).select("source_id", "content_hash"), "hashes")
    path = new_folder(spark, "store")
    before = write_store(views.kb_stored_before(spark, sf_dir, hashes), path)
    stored = write_changes(ingest(files, before).changes, path)
    written = spark.read.parquet(f"{path}/{stored.version.segments[-1]}/documents").select(F.col("id").alias("source_id"), F.lit(True).alias("written"))
    sections = stored.chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return stored.documents.join(sections, "source_id", "left").join(written, "source_id", "left").select(
        "source_id", "file_name", "content_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("written", F.lit(False)).alias("rewritten"),
    )


@query
def s6_stored_segments(spark, sf_dir):
    """Documents with chunks from a store of two segments, the second of which replaced, removed and added documents."""
    store = views.kb_store(spark, sf_dir)
    earlier, changed = views.kb_earlier_store(spark, sf_dir, store)
    path, changed = new_folder(spark, "store"), materialize(changed, "changed")
    before = write_store(earlier, path)
    documents, chunks = (rows.join(changed, "source_id", "left_semi") for rows in (store.documents, store.chunks))
    stored = write_changes(StoreChanges(before.version, documents, chunks, changed), path)
    return documents_with_chunks(stored).select(
        "source_id", "title", "version", F.col("chunk_order").cast("bigint").alias("chunk_order"), "section_path",
        F.md5("content").alias("content_md5"),
    )


@query
def s9_index_stats(spark, sf_dir):
    index = workbench(spark, sf_dir).index
    sizes = index.postings.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences"))
    vocabulary = index.terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("total_df"))
    parts = [sizes.select(F.lit(p).alias("statistic"), F.col(p).alias("value")) for p in ("postings", "occurrences")]
    parts += [vocabulary.select(F.lit(p).alias("statistic"), F.col(p).alias("value")) for p in ("terms", "total_df")]
    parts += [index.chunks.groupBy().count().select(F.lit("chunks").alias("statistic"), F.col("count").alias("value"))]
    parts += [index.versions.groupBy().count().select(F.lit("documents").alias("statistic"), F.col("count").alias("value"))]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- predicates ----------------------------------------------------------------------------------


@query
def p1_query_validation(spark, sf_dir):
    checked = validate_queries(views.kb_requests(spark, sf_dir))
    return checked.select("query_id", F.length("text").cast("bigint").alias("n_chars"), *_big("top_k", "status"), "message_code")


@query
def p4_pending_embeddings(spark, sf_dir):
    chunks = views.kb_chunks_with_vectors(spark, sf_dir, mixed_models=True)
    return chunks.where(embedding_pending(MODEL)).select("source_id", *_big("chunk_order"), "embedding_model")


@query
def p6_evidence_gate(spark, sf_dir):
    evidence = enough_evidence(F.col("mode"), F.col("max_dense"), F.col("max_coverage"))
    return workbench(spark, sf_dir).hybrid.stats.select("query_id", evidence.alias("evidence"))


@query
def p7_refusal_reason(spark, sf_dir):
    return workbench(spark, sf_dir).validated.answers.select("query_id", "answerable", "refusal_reason")


@query
def p9_duplicate_ids(spark, sf_dir):
    spelled = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    sources = views.table(spark, sf_dir, "documents").select(
        spelled.alias("source_id"), F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("file_name")
    )
    return duplicate_ids(sources)


# --- text, vectors, replies ----------------------------------------------------------------------


@query
def t1_normalize(spark, sf_dir):
    normalized = views.documents(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("normalized"))
    return normalized.select("doc_id", F.length("normalized").cast("bigint").alias("n_chars"), F.md5("normalized").alias("normalized_md5"))


@query
def t2_tokens(spark, sf_dir):
    terms = views.documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@query
def t5_embedding_text(spark, sf_dir):
    titled = views.kb_chunks(spark, sf_dir).join(views.kb_documents(spark, sf_dir).select("source_id", "title"), "source_id")
    text = embedding_text(F.col("title"), F.col("section_path"), F.col("content"), "title: {title} | text: ")
    return titled.select("source_id", *_big("chunk_order"), F.md5(text).alias("text_md5"))


@query
def t6_unit_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * (F.col("vec_id") % 7)).cast("float"))
    units = views.table(spark, sf_dir, "embeddings").select("vec_id", unit_length(scaled).alias("unit"))
    return units.select(
        "vec_id", *[F.round(part.cast("double"), 5).alias(name) for name, part in
                    (("first_part", F.get("unit", F.lit(0))), ("largest", F.array_max("unit")), ("smallest", F.array_min("unit")))]
    )


@query
def t7_cosine(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vectors = vectors.count()
    following = vectors.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next_embedding"))
    pairs = vectors.withColumn("next_id", (F.col("vec_id") + 1) % n_vectors).join(following, "next_id")
    similarity = cosine_similarity(F.col("embedding"), F.col("next_embedding"))
    return pairs.select("vec_id", "next_id", stable(similarity, 6).alias("cosine"))


@query
def t8_labels(spark, sf_dir):
    items = views.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    spelled = F.replace(F.expr(views.LABEL_SPELLINGS_SQL), F.lit("1"), F.col("query_id").cast("string"))
    return items.select("query_id", answer_functions.source_label(spelled).alias("label"))


@query
def t9_clean_answer(spark, sf_dir):
    told = F.concat(
        F.lit("  Buna göre [C1] \""), F.col("text"), F.lit("\" [C2, \"x\"][C3].   Ayrıca (C1, C2)\t “"), F.col("text"), F.lit("” son (Cuma). ")
    )
    return views.table(spark, sf_dir, "benchmark").select(
        "item_id", answer_functions.clean_answer(told, F.array("text")).alias("answer")
    )


@query
def t10_verbatim(spark, sf_dir):
    content = F.col("content")
    half = F.floor(F.length("content") / 2).cast("int")
    start, end = F.substr("content", F.lit(1), half), F.substr("content", half + 2)
    quote = (
        F.when(F.col("chunk_order") % 4 == 0, F.lower("content"))
        .when(F.col("chunk_order") % 4 == 1, F.concat(start, F.lit(" ... "), end))
        .when(F.col("chunk_order") % 4 == 2, F.concat(start, F.lit(" xyzxyz… "), end))
        .otherwise(F.lit(" … ..."))
    )
    return views.kb_chunks(spark, sf_dir).select(
        "source_id", *_big("chunk_order"), answer_functions.is_verbatim(quote, normalize(content)).alias("verified")
    )


@query
def t12_version_order(spark, sf_dir):
    documents = views.kb_documents(spark, sf_dir)
    spelled = F.when(F.col("doc_id") % 7 == 0, F.concat("version", F.lit(".3"))).when(
        F.col("doc_id") % 7 == 1, F.concat(F.lit("v"), "version")
    ).otherwise(F.col("version"))
    return documents.select(
        "source_id", F.array_join(F.transform(version_key(spelled), lambda p: p.cast("string")), ".").alias("version_key")
    )


@query
def t15_prompt(spark, sf_dir):
    prompts = workbench(spark, sf_dir).asked.prompts
    return prompts.select("query_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def t16_parse_reply(spark, sf_dir):
    reply = F.to_json(
        F.struct(
            (F.col("item_id") % 3 != 0).alias("answerable"), F.col("text").alias("answer"),
            F.array(
                F.struct(F.concat(F.lit("C"), F.col("item_id").cast("string")).alias("chunkId"), F.col("text").alias("quote")),
                F.struct(F.lit("  ").alias("chunkId"), F.col("text").alias("quote")),
                F.struct(F.lit("C1").alias("chunkId"), F.lit(None).cast("string").alias("quote")),
            ).alias("citations"),
            F.slice(
                F.array(*[F.struct(F.col("text").alias("topic"), F.lit(c).alias("chosenChunkId"), F.array(F.lit("C2")).alias("rejectedChunkIds")) for c in ("C1", "C3")]),
                F.lit(1), (F.col("item_id") % 3).cast("int"),
            ).alias("conflicts"),
        )
    )
    broken = F.when(F.col("item_id") % 4 == 3, F.col("text")).otherwise(reply)
    parsed = views.table(spark, sf_dir, "benchmark").select("item_id", answer_functions.parse_reply(broken).alias("p"))
    return parsed.select(
        "item_id", "p.valid", "p.answerable", "p.answer",
        F.array_join(F.transform("p.citations", lambda c: F.concat(c["label"], F.lit("="), F.md5(c["quote"]))), ",").alias("citations"),
        F.size("p.conflicts").cast("bigint").alias("n_conflicts"),
        F.array_join(F.transform("p.conflicts", lambda c: F.concat(c["chosen"], F.lit("<"), F.array_join(c["rejected"], ";"), c["reason"])), ",").alias("conflicts"),
    )


# --- chunking ------------------------------------------------------------------------------------


@query
def c1_sections(spark, sf_dir):
    sections = views.kb_markdown(spark, sf_dir).select("source_id", F.posexplode(heading_sections(F.col("body"))).alias("section_no", "s"))
    return sections.select("source_id", *_big("section_no"), F.col("s.level").cast("bigint").alias("level"), F.col("s.text").alias("heading"), F.md5("s.content").alias("content_md5"))


@query
def c2_heading_path(spark, sf_dir):
    addressed = addressed_sections(heading_sections(F.col("body")), F.col("title"))
    sections = views.kb_markdown(spark, sf_dir).select("source_id", F.posexplode(addressed).alias("section_no", "s"))
    return sections.select("source_id", *_big("section_no"), F.col("s.section_path").alias("section_path"), F.md5("s.content").alias("content_md5"))


@query
def c3_packed_chunks(spark, sf_dir):
    return views.kb_chunks(spark, sf_dir).select(
        "source_id", "section_path", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query
def c4_chunk_order(spark, sf_dir):
    return views.kb_chunks(spark, sf_dir).select("source_id", *_big("chunk_order"), F.md5("content").alias("content_md5"))


# --- joins ---------------------------------------------------------------------------------------


@query
def j1_bm25_matches(spark, sf_dir):
    return workbench(spark, sf_dir).scored().groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("matched_terms").alias("matched_terms"), F.max("matched_terms").alias("most_terms")
    )


@query
def j2_query_idf(spark, sf_dir):
    terms = workbench(spark, sf_dir).lexical_queries.terms
    return terms.select("query_id", "term", *_big("df"), stable(F.col("idf"), 8).alias("idf"), stable(F.col("total_idf"), 8).alias("total_idf"))


def _reconciled(spark, sf_dir) -> DataFrame:
    catalog = materialize(parse_markdown(views.kb_files(spark, sf_dir, faulty=False)).drop("body"), "catalog")
    stored = views.kb_stored_before(spark, sf_dir, catalog.select("source_id", "content_hash"))
    return reconcile(catalog, stored.documents)


@query
def j3_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("source_id", "file_name", "action", "content_hash")


@query
def j5_dense_scores(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    pairs = bench.lexical.hits.select("query_id", "doc_no", "chunk_order")
    scores = dense_scores(bench.index.vectors, bench.hybrid_queries.queries, pairs)
    return bench.with_source(scores).select("query_id", "source_id", *_big("chunk_order"), "dense_score")


@query
def j8_kept(spark, sf_dir):
    return workbench(spark, sf_dir).asked.resolution.kept.select("query_id", *_big("rank"), "source_id", *_big("chunk_order"))


@query
def j9_discarded(spark, sf_dir):
    return workbench(spark, sf_dir).asked.resolution.discarded.select("query_id", "source_id", *_big("first_rank"), "version", "effective_date", "reason")


@query
def j10_substitution(spark, sf_dir):
    return workbench(spark, sf_dir).asked.resolution.needs_substitution.select("query_id", "document_key", "source_id", *_big("replaced_rank"))


@query
def j11_citations(spark, sf_dir):
    return workbench(spark, sf_dir).validated.citations.select(
        "query_id", *_big("position"), "label", "source_id", "section_path", F.md5("quote").alias("quote_md5"), "quote_verified"
    )


@query
def j12_conflicts(spark, sf_dir):
    rejected = F.array_join(F.transform("rejected", lambda r: F.concat(r["source_id"], F.lit("/"), r["section_path"])), ",")
    return workbench(spark, sf_dir).validated.conflicts.select(
        "query_id", *_big("conflict_no"), "topic", F.col("chosen.source_id").alias("chosen_id"), rejected.alias("rejected"), "reason"
    )


@query
def j13_lookup(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit(" doc-"), F.lpad((F.col("item_id") * 37).cast("string"), 19, "0"), F.lit("\n")).alias("requested_id")
    )
    store = Store(views.document_rows(views.kb_documents(spark, sf_dir)), None)
    return look_up(store, wanted).select("source_id", "document_key", "version", *_big("http_status"))


# --- aggregates ----------------------------------------------------------------------------------


def _term_frequencies(spark, sf_dir) -> DataFrame:
    titled = views.kb_chunks(spark, sf_dir).join(views.kb_documents(spark, sf_dir).select("source_id", "title"), "source_id")
    return bm25.term_frequencies(titled, ("source_id", "chunk_order"))


@query
def a1_term_freq(spark, sf_dir):
    return _term_frequencies(spark, sf_dir).select("source_id", *_big("chunk_order", "dl"), "term", *_big("tf"))


@query
def a2_doc_freq(spark, sf_dir):
    return bm25.document_frequencies(_term_frequencies(spark, sf_dir)).select("term", *_big("df"))


@query
def a3_corpus(spark, sf_dir):
    average = F.greatest(F.lit(1.0), F.col("n_terms") / F.col("n_chunks"))
    return workbench(spark, sf_dir).index.summary.select("n_chunks", "n_terms", F.round(average, 6).alias("average_length"))


def _digest(scored: DataFrame, column: str) -> DataFrame:
    """One row per query over all its matches; the matches themselves, queries x chunks, stay where they are scored."""
    exact = F.sum(F.col(column).cast("decimal(20,8)")).alias("total")
    return scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), exact, F.max(column).alias("best"), F.min(column).alias("least"))


@query
def a4_bm25(spark, sf_dir):
    return _digest(workbench(spark, sf_dir).scored(), "score")


@query
def a5_coverage(spark, sf_dir):
    return _digest(workbench(spark, sf_dir).scored(), "coverage")


@query
def a6_query_stats(spark, sf_dir):
    return workbench(spark, sf_dir).hybrid.stats


@query
def a7_rrf(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return bench.with_source(bench.hybrid.hits).select("query_id", "source_id", *_big("chunk_order"), F.round("fused_score", 12).alias("fused_score"))


@query
def a8_families(spark, sf_dir):
    return document_versions(views.kb_documents(spark, sf_dir)).select("document_key", "source_id", "version", "effective_date", *_big("n_versions"))


@query
def a9_mode(spark, sf_dir):
    one = vectors_usable(views.kb_chunks_with_vectors(spark, sf_dir), MODEL).select(F.lit("one model").alias("store"), "chunks", "mode")
    two = vectors_usable(views.kb_chunks_with_vectors(spark, sf_dir, mixed_models=True), MODEL).select(F.lit("two models").alias("store"), "chunks", "mode")
    return one.unionByName(two)


@query
def a10_ingest_summary(spark, sf_dir):
    return action_counts(_reconciled(spark, sf_dir))


@query
def a11_section_count(spark, sf_dir):
    return list_documents(_plain_store(spark, sf_dir)).select("source_id", *_big("section_count"))


@query
def a12_conflict_rule(spark, sf_dir):
    return workbench(spark, sf_dir).validated.conflicts.select("query_id", *_big("conflict_no"), "rule_satisfied")


@query
def a14_status(spark, sf_dir):
    return status(workbench(spark, sf_dir).index, spark, generator="g", embedder=MODEL)


# --- ranking -------------------------------------------------------------------------------------


@query
def w1_lexical_topk(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    prepared = bench.lexical_queries
    scored = bm25.score_matches(
        bench.index.postings, prepared.terms, bench.index.average_length,
        n_terms=prepared.n_terms,
    )
    bounds = materialize(bm25.match_bounds(scored, DEFAULTS.candidate_pool), "match-bounds")
    ranked = bm25.best_matches(scored, bounds, DEFAULTS.candidate_pool)
    return bench.with_source(ranked).select("query_id", *_big("rank"), "source_id", *_big("chunk_order"), "score", "coverage")


@query
def w1_lexical_blocks(spark, sf_dir):
    """The same pool by block maxima."""
    bench = workbench(spark, sf_dir)
    return bench.with_source(bench.lexical.lexical.ranked).select("query_id", *_big("rank"), "source_id", *_big("chunk_order"), "score", "coverage")


@query
def w2_dense_topk(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    ranked = nearest_chunks(bench.index.vectors, bench.hybrid_queries.queries, DEFAULTS.candidate_pool)
    return bench.with_source(ranked).select("query_id", *_big("rank"), "source_id", *_big("chunk_order"), "dense_score")


@query
def w2_dense_cells(spark, sf_dir):
    """As ``w2_dense_topk``, from the vectors by cell: cells that cannot hold one of a query's best are not scored."""
    chunks = views.kb_chunks_with_vectors(spark, sf_dir)
    number = F.expr("cast(substring(source_id, 5) as bigint)")  # ids are padded numbers, so in the order of file names
    vectors = materialize(chunks.select(number.alias("doc_no"), "chunk_order", "embedding"), "vectors")
    found = nearest_in_cells(build_cells(vectors), views.kb_queries(spark, sf_dir), DEFAULTS.candidate_pool)
    source_id = F.concat(F.lit("doc-"), F.lpad(F.col("doc_no").cast("string"), 19, "0")).alias("source_id")
    return found.ranked.select("query_id", *_big("rank"), source_id, *_big("chunk_order"), "dense_score")


@query
def w3_fused_topk(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return bench.with_source(bench.hybrid.hits).select("query_id", *_big("rank"), "source_id", *_big("chunk_order"))


@query
def w4_current_version(spark, sf_dir):
    return current_versions(views.kb_documents(spark, sf_dir), AS_OF).select("document_key", *_big("n_versions"), "current.source_id", "current.version")


@query
def w6_context_labels(spark, sf_dir):
    return workbench(spark, sf_dir).asked.context.select("query_id", "label", "source_id", *_big("chunk_order"))


@query
def u2_substituted_context(spark, sf_dir):
    """Context entries that stand in for an outdated version."""
    asked = workbench(spark, sf_dir).asked
    wanted = asked.resolution.needs_substitution.select("query_id", "source_id", "replaced_rank")
    return asked.context.join(wanted, ["query_id", "source_id"]).select("query_id", *_big("position"), "source_id", *_big("chunk_order", "replaced_rank"))


# --- model hooks ---------------------------------------------------------------------------------


def measure_texts(texts):
    """Stands in for an embedder: two lengths of each text; it refuses any batch with a key in it."""
    if any("AKIA" in t for t in texts):
        raise ValueError("a key in the text")
    return [[float(len(t)), float(t.count("e") + 1)] for t in texts]


@query
def x1_embed(spark, sf_dir):
    """Vectors of all documents; of a batch that is refused, the texts that can be embedded alone still are."""
    texts = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("embed_text"))
    done = embed_texts(texts, measure_texts, batch_size=16, retry_single=True)
    return done.select(
        "doc_id", F.col("embed_error").isNotNull().alias("failed"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first_part"),
        F.round(F.get("vector", F.lit(1)).cast("double"), 5).alias("second_part"),
    )


def one_part(texts):
    """Stands in for an embedder whose vectors can be told from the given ones by their length."""
    return [[1.0] for _ in texts]


@query
def x1_reused_vectors(spark, sf_dir):
    """Every file has a note at its end that the stored document lacks: which chunks keep the vector of a stored chunk."""
    store = views.kb_store(spark, sf_dir)
    outcome = ingest(views.kb_files(spark, sf_dir, faulty=False), store, one_part, EmbeddingOptions(model=MODEL, batch_size=1024))
    reused = F.size("embedding") > 1
    return outcome.store.chunks.select(
        "source_id", *_big("chunk_order"), F.md5("content").alias("content_md5"), reused.alias("reused"),
        F.when(reused, F.round(F.get("embedding", F.lit(0)).cast("double"), 5)).alias("first_part"),
    )


def digest_reply(messages: list[dict]) -> dict:
    """A generator for the ledger: texts of some lengths meet an outage, or no JSON."""
    import hashlib

    text = messages[1]["content"]
    if len(text) % 7 == 0:
        raise OSError("outage")
    digest = hashlib.md5(text.encode()).hexdigest()
    return {"text": "no json" if len(text) % 7 == 1 else f'{{"answer": "{digest}"}}', "model": MODEL}


@query
def x2_reply_ledger(spark, sf_dir):
    """The turns of users are asked, then all turns: whose reply is kept from the first run."""
    turns = views.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"), "role"
    )
    ledger = ReplyLedger(new_folder(spark, "replies"), MODEL, calls_per_commit=4096)
    answers_with_ledger(turns.where("role = 'user'"), digest_reply, ledger)
    answers = answers_with_ledger(turns, digest_reply, ledger)
    return answers.select("query_id", F.get_json_object("reply", "$.answer").alias("answer"), "failure", *_big("attempts"), "kept")


# --- whole jobs ----------------------------------------------------------------------------------


@query
def l1_ingest_summary(spark, sf_dir):
    files = views.kb_files(spark, sf_dir, faulty=False)
    hashes = materialize(parse_markdown(files).select("source_id", "content_hash"), "hashes")
    before = views.kb_stored_before(spark, sf_dir, hashes)
    return ingest(files, before).summary


def _hit_rows(bench: Workbench, hits: DataFrame, index: KnowledgeIndex | None = None) -> DataFrame:
    return with_chunks(index or bench.index, hits).select(
        "query_id", *_big("rank"), "source_id", *_big("chunk_order"), "document_key", "version", "effective_date", "status", "category",
        "section_path", F.md5("content").alias("content_md5"), F.round("fused_score", 12).alias("fused_score"), "lexical_score", "coverage",
        "dense_score",
    )


@query
def l4_search_lexical(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return _hit_rows(bench, bench.lexical.hits)


@query
def l4_search_hybrid(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return _hit_rows(bench, bench.hybrid.hits)


@query
def l4_search_filtered(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return _hit_rows(bench, search(bench.index, bench.hybrid_queries, where=F.col("category").isin("politika", "prosedur")).hits)


@query
def l2_incremental_index(spark, sf_dir):
    """Search in an index that was brought up to date by a segment."""
    bench = workbench(spark, sf_dir)
    index = bench.updated_index
    found = search(index, prepare(index, views.kb_queries(spark, sf_dir).drop("vector")))
    return _hit_rows(bench, found.hits, index)


@query
def l2_incremental_stats(spark, sf_dir):
    """Terms of the updated index with their document frequencies, and its counts under empty terms."""
    index = workbench(spark, sf_dir).updated_index
    counts = index.summary.select(F.expr("stack(3, ' documents', n_documents, ' chunks', n_chunks, ' occurrences', n_terms) as (term, df)"))
    return index.terms.select("term", *_big("df")).unionByName(counts)


@query
def l5_as_of_resolution(spark, sf_dir):
    """Versions resolved on a day of its own for every question."""
    return workbench(spark, sf_dir).asked_on_own_days.resolution.hits.select(
        "query_id", "as_of", *_big("rank"), "source_id", "multi_version", "kept", "reason", F.col("current.source_id").alias("current_id"), "needs_substitution"
    )


@query
def l5_resolution(spark, sf_dir):
    return workbench(spark, sf_dir).asked.resolution.hits.select(
        "query_id", *_big("rank"), "source_id", "multi_version", "kept", "reason", F.col("current.source_id").alias("current_id"), "needs_substitution"
    )


@query
def l4_search_requests(spark, sf_dir):
    """Search with its checks over all turns of the conversations; and once more as if there were no index."""
    bench = workbench(spark, sf_dir)
    requests = views.kb_requests(spark, sf_dir)
    checked, result = search_requests(bench.index, requests)
    found = result.hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    answered = checked.join(found, "query_id", "left").select(F.lit("ready").alias("state"), "query_id", *_big("status"), "message_code", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    without, _ = search_requests(None, requests)
    return answered.unionByName(without.select(F.lit("no index").alias("state"), "query_id", *_big("status"), "message_code", F.lit(0).cast("bigint").alias("n_hits")))


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "kind", "document_key", "source_id", "version", "effective_date", "reason")


@query
def l6_report_cited(spark, sf_dir):
    bench = workbench(spark, sf_dir)
    return _report(ask.version_report(bench.asked.resolution, bench.validated.citations))


@query
def l6_report_retrieved(spark, sf_dir):
    return _report(ask.version_report(workbench(spark, sf_dir).asked.resolution))


@query
def l7_context(spark, sf_dir):
    return workbench(spark, sf_dir).asked.context.select(
        "query_id", *_big("position"), "label", "source_id", *_big("chunk_order"), "version", "section_path", F.md5("content").alias("content_md5")
    )


@query
def l8_validated_answers(spark, sf_dir):
    return workbench(spark, sf_dir).validated.answers.select("query_id", "valid", "answerable", "answer", "missing_information", "refusal_reason")


def quote_first_line(messages: list[dict]) -> dict:
    """Stands in for a model: answers with the first line of the first source; the line's length says how well it works."""
    import json

    lines = messages[1]["content"].split("\n")
    if not lines[2].startswith("[C1] "):
        text = {"answerable": False, "missingInformation": "kaynak yok"}
    elif len(lines[4]) % 5 == 0:
        raise RuntimeError("no model at the moment")
    elif len(lines[4]) % 5 == 1 or (len(lines[4]) % 5 == 2 and len(messages) == 2):  # the latter is right when asked again
        return {"text": "no JSON", "model": "first-line"}
    else:
        text = {"answerable": True, "answer": lines[4] + " [C1]", "citations": [{"chunkId": "c1", "quote": lines[4]}]}
    return {"text": json.dumps(text), "model": "first-line", "input_tokens": 1, "output_tokens": 1}


@query
def l9_answers(spark, sf_dir):
    answers = workbench(spark, sf_dir).answers
    ids = F.array_join(F.transform("sources", lambda s: s["documentId"]), ",")
    return answers.select(
        "query_id", *_big("status"), "answerable", "refusal_reason", "answer", ids.alias("source_ids"),
        F.forall("sources", lambda s: s["quoteVerified"]).alias("all_verified"), F.col("version_resolution.applied").alias("applied"),
        F.size("version_resolution.selected").cast("bigint").alias("n_selected"),
        F.size("version_resolution.discarded").cast("bigint").alias("n_discarded"),
    )


@query
def l10_documents(spark, sf_dir):
    return list_documents(_plain_store(spark, sf_dir)).select(
        "source_id", "document_key", "title", "version", "effective_date", "status", "category", "supersedes", *_big("section_count")
    )


@query
def l11_sections(spark, sf_dir):
    store = _plain_store(spark, sf_dir)
    wanted = store.documents.select(F.concat(F.lit(" "), F.col("source_id"), F.lit(" ")).alias("requested_id"))
    return document_detail(store, wanted).select("source_id", *_big("http_status", "chunk_order"), "section_path", F.md5("content").alias("content_md5"))
