"""Knowledge-base views over the given tables.

The tables hold plain texts, so documents, markdown files, stored state,
queries and replies are derived from them. Every view keeps all rows and whole
texts. Expressions in SQL text mean the same in both engines.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators.chunking import chunk_documents
from lexifold.sources.scratch import spread
from lexifold.sources.store import CHUNK_SCHEMA, DOCUMENT_SCHEMA, Store

AS_OF = datetime.date(2025, 6, 1)
MODEL = "m1"

DOCUMENTS_SQL = """
select doc_id, concat('doc-', lpad(cast(doc_id as string), 19, '0')) as source_id,
  concat('doc-', lpad(cast(doc_id as string), 19, '0'), '.md') as file_name,
  case when doc_id % 4 = 3 then concat('solo-', cast(doc_id as string))
       else concat('fam-', cast(cast(floor(doc_id / 4) as bigint) as string)) end as document_key,
  concat('Belge ', source) as title,
  case doc_id % 4 when 0 then '1.9' when 1 then '1.10' when 2 then '2.0' else '1.0' end as version,
  date '2024-01-01' + cast(case when doc_id % 4 = 2 then (doc_id * 37) % 900
       else cast(floor(doc_id / 4) as bigint) % 300 end as int) as effective_date,
  case when cast(floor(doc_id / 4) as bigint) % 11 = 0 or doc_id % 12 = 1
       then 'superseded' else 'active' end as status,
  case doc_id % 5 when 0 then 'politika' when 1 then 'prosedur' when 2 then 'kilavuz' else 'sss' end as category,
  case when doc_id % 4 in (1, 2) then concat('doc-', lpad(cast(doc_id - 1 as string), 19, '0')) end as supersedes,
  text
from documents
"""

# A well-formed file of each document; the closing line makes sure that it has a section.
HEADER_SQL = """concat('id: ', source_id, chr(10), 'documentKey: ', document_key, chr(10), 'title: "', title, '"', chr(10),
  'version: ''', version, '''', chr(10), 'effectiveDate: ', cast(effective_date as string), chr(10),
  'status: ', status, ' # durum', chr(10), 'owner: ekip', chr(10),
  'supersedes: ', coalesce(supersedes, '""'), chr(10), 'category: ', category)"""
VALID_FILE_SQL = f"concat('---', chr(10), {HEADER_SQL}, chr(10), '---', chr(10), body, chr(10), 'Son not.', chr(10))"

# The same file with one fault by document: line ends, id, status, date, closing line, body, a value that is not flat.
FAULTY_FILE_SQL = f"""case doc_id % 9
  when 1 then replace(valid_text, chr(10), concat(chr(13), chr(10)))
  when 2 then replace(valid_text, concat('id: ', source_id, chr(10)), '')
  when 3 then replace(valid_text, concat('status: ', status), 'status: draft')
  when 4 then replace(valid_text, concat('effectiveDate: ', cast(effective_date as string)), 'effectiveDate: 01.06.2025')
  when 5 then replace(valid_text, concat(chr(10), '---', chr(10)), concat(chr(10), '--', chr(10)))
  when 6 then concat('---', chr(10), {HEADER_SQL}, chr(10), '---', chr(10), chr(10))
  when 7 then replace(valid_text, concat('title: "', title, '"'), concat('title: >', chr(10), '  ', title))
  else valid_text end"""

# The day on which a question is asked.
OWN_DAY_SQL = "date '2024-01-01' + cast(query_id * 97 % 1100 as int)"

REQUESTS_SQL = """
select conv_id * 1000 + turn as query_id,
  case when conv_id % 10 = 9 then '   ' else text end as text,
  case when role = 'user' then cast(null as int) else cast(turn * 7 as int) end as top_k
from conversations
"""

# Replies a model might give to the context of a query; the sixth is no JSON.
LABEL_SPELLINGS_SQL = """case query_id % 5 when 0 then '[C1]' when 1 then 'c1' when 2 then '(1)' when 3 then ' C1 ' else '1' end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOCUMENTS_SQL.replace("from documents", "from {documents}"), documents=documents(spark, sf_dir))


def kb_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line becomes a paragraph; a section heading goes before every eighth, a sub-heading before the one four below."""

    def markdown_line(line, i):
        heading = (
            F.when(i % 8 == 0, F.concat(F.lit("## Bölüm "), i.cast("string"), F.lit("\n")))
            .when(i % 8 == 4, F.concat(F.lit("### Alt "), i.cast("string"), F.lit(" ##\n")))
            .otherwise("")
        )
        return F.concat(heading, line, F.lit("\n"))

    body = F.array_join(F.transform(F.split("text", "\n"), markdown_line), "\n")
    return kb_documents(spark, sf_dir).withColumn("body", body).drop("text")


def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(kb_markdown(spark, sf_dir).select("source_id", "title", "body"))


def kb_files(spark: SparkSession, sf_dir: str, faulty: bool) -> DataFrame:
    valid = kb_markdown(spark, sf_dir).withColumn("valid_text", F.expr(VALID_FILE_SQL))
    return valid.select("file_name", (F.expr(FAULTY_FILE_SQL) if faulty else F.col("valid_text")).alias("text"))


def with_every_vector(joined: DataFrame, column: str) -> DataFrame:
    """Fails on a row that met no vector, where an inner join would drop it."""
    gap = F.raise_error(F.lit("the vectors are not numbered from 0 without gaps"))
    return joined.withColumn(column, F.coalesce(F.col(column), gap))


def kb_chunks_with_vectors(spark: SparkSession, sf_dir: str, mixed_models: bool = False) -> DataFrame:
    """Each chunk takes one of the given vectors; with ``mixed_models`` every fiftieth comes from another model."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vectors = embeddings.count()
    doc_id = F.expr("cast(substring(source_id, 5) as bigint)")
    numbered = kb_chunks(spark, sf_dir).withColumn("vec_id", (doc_id * 31 + F.col("chunk_order") * 7) % n_vectors)
    model = F.when(F.col("vec_id") % 50 == 0, "m2").otherwise(MODEL) if mixed_models else F.lit(MODEL)
    return with_every_vector(numbered.join(embeddings, "vec_id", "left"), "embedding").select(
        "source_id", "chunk_order", "section_path", "content", "embedding", model.alias("embedding_model")
    )


def document_rows(documents: DataFrame) -> DataFrame:
    """Shaped as stored documents."""
    columns = DOCUMENT_SCHEMA.replace(",", "").split()
    given = {"content_hash": F.upper(F.sha2("source_id", 256))}
    names = list(zip(columns[0::2], columns[1::2], strict=True))
    return documents.select(
        *[
            (F.col(name) if name in documents.columns else given.get(name, F.lit(None).cast(kind))).alias(name)
            for name, kind in names
        ]
    )


def kb_store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(document_rows(kb_documents(spark, sf_dir)), kb_chunks_with_vectors(spark, sf_dir))


def kb_stored_before(spark: SparkSession, sf_dir: str, hashes: DataFrame) -> Store:
    """An earlier state of the store, by what ``labels`` says of a document.

    Labelled documents are stored: with another hash where the quality is 0, in
    upper case where toxic; one document per benchmark item has left the source.
    ``hashes``: ``source_id, content_hash`` of the files.
    """
    documents = kb_documents(spark, sf_dir).join(hashes, "source_id").join(table(spark, sf_dir, "labels"), "doc_id")
    kept = documents.withColumn("source_id", F.when(F.col("toxic") == 1, F.upper("source_id")).otherwise(F.col("source_id")))
    kept = kept.withColumn(
        "content_hash", F.when(F.col("quality") == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
    )
    gone = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("old-"), F.col("item_id").cast("string")).alias("source_id"),
        F.concat(F.lit("old-"), F.col("item_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.lit("old").alias("content_hash"),
    )
    stored = document_rows(kept).unionByName(document_rows(gone))
    chunk_columns = CHUNK_SCHEMA.replace(",", "").split()
    given = {"chunk_order": F.lit(0), "section_path": F.lit("Eski"), "content": F.lit("eski metin")}
    chunks = stored.select(
        "source_id",
        *[
            given.get(name, F.lit(None).cast(kind)).alias(name)
            for name, kind in zip(chunk_columns[2::2], chunk_columns[3::2], strict=True)
        ],
    )
    return Store(stored, chunks)


def kb_earlier_store(spark: SparkSession, sf_dir: str, store: Store) -> tuple[Store, DataFrame]:
    """A former state of ``store`` with its chunks, and the ids that differ: see ``kb_stored_before`` for what ``labels`` say."""
    labels = kb_documents(spark, sf_dir).select("doc_id", "source_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    old = F.concat(F.lit("old-"), F.col("item_id").cast("string"))
    gone = table(spark, sf_dir, "benchmark").select(old.alias("source_id"), F.concat(old, F.lit(".md")).alias("file_name"))
    gone = gone.withColumns({"document_key": F.col("source_id"), "title": F.lit("Eski"), "version": F.lit("1.0"), "status": F.lit("active"), "category": F.lit("sss")})
    gone = gone.withColumn("effective_date", F.lit("2023-01-01").cast("date"))
    known = labels.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    documents = store.documents.join(known, "source_id", "left_semi").unionByName(document_rows(gone))
    former = labels.where("quality = 0").select("source_id")
    same = store.chunks.join(known, "source_id", "left_semi").join(former, "source_id", "left_anti")
    columns = CHUNK_SCHEMA.replace(",", "").split()
    given = {"chunk_order": F.lit(0), "section_path": F.lit("Eski"), "content": F.concat(F.lit("eski metin the and "), F.col("source_id"))}
    kinds = list(zip(columns[0::2], columns[1::2], strict=True))[1:]
    other = former.unionByName(gone.select("source_id")).select(
        "source_id", *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds]
    )
    added = labels.join(known, "source_id", "left_anti").select("source_id")
    changed = added.unionByName(former).unionByName(gone.select("source_id"))
    return Store(documents, same.unionByName(other)), changed


def kb_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text is a query; its vector is one of the given ones."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n_vectors = embeddings.count()
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", (F.col("item_id") % n_vectors).alias("vec_id")
    )
    return with_every_vector(items.join(embeddings, "vec_id", "left"), "vector").select("query_id", "text", "vector")


def kb_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        REQUESTS_SQL.replace("from conversations", "from {conversations}"), conversations=table(spark, sf_dir, "conversations")
    )


def kb_replies(context: DataFrame) -> DataFrame:
    """One made-up reply per query with a context, in six manners; from the first two sources it was given."""
    first = context.where(F.col("position") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("content"))).alias("one"),
        F.max(F.when(F.col("position") == 2, F.col("content"))).alias("two"),
    )
    label = F.expr(LABEL_SPELLINGS_SQL)

    def cite(where, quote):
        return F.struct(where.alias("chunkId"), quote.alias("quote"))

    manner = F.col("query_id") % 6
    no_conflict = F.array().cast("array<struct<topic:string,chosenChunkId:string,rejectedChunkIds:array<string>,reason:string>>")
    unknown = cite(F.lit("C9"), F.col("one"))
    citations = (
        F.when(manner == 0, F.array(cite(label, F.col("one"))))
        .when(manner == 1, F.array(cite(label, F.lower("one")), unknown))
        .when(manner == 2, F.array(cite(label, F.concat(F.lit("başka "), F.col("one")))))
        .when(manner == 3, F.array(unknown))
        .when(manner == 4, F.array(cite(label, F.col("one"))))
        .otherwise(F.array(cite(label, F.col("one")), cite(F.lit("C2"), F.col("two")), cite(F.lit("C1"), F.col("one"))))
    )

    def dispute(chosen, rejected):
        return F.struct(
            F.lit(" konu ").alias("topic"), chosen.alias("chosenChunkId"), rejected.alias("rejectedChunkIds"), F.lit("neden").alias("reason")
        )

    disputes = F.array(
        dispute(label, F.array(F.lit("C2"), F.lit("C1"), F.lit("[c3]"), F.lit("C9"), F.lit("2"))),
        dispute(F.lit("C9"), F.array(F.lit("C1"))),
        dispute(F.lit("C2"), F.array(F.lit("C2"), F.lit("c1"))),
    )
    reply = F.struct(
        (manner != 4).alias("answerable"),
        F.concat(F.lit("Yanıt [C1, \"x\"]: \""), F.col("one"), F.lit("\"  son (C1, C2).")).alias("answer"),
        citations.alias("citations"),
        F.when(manner == 4, " eksik bilgi ").otherwise("").alias("missingInformation"),
        F.when(manner.isin(0, 5), disputes).otherwise(no_conflict).alias("conflicts"),
    )
    return first.select("query_id", F.to_json(reply).alias("reply"))
