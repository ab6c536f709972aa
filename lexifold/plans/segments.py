"""Incremental index: a segment for the documents that changed, and one segment again when there are many.

``update_index`` writes tables for the changed documents only, takes back what their former versions added to the
document frequencies, and notes the former numbers as dead; counts follow by addition and subtraction. All other
segments are read as they are, and an index that is being read never changes: the new one has a folder of its own,
whose summary, written last, names the segments it consists of.

New documents get numbers between those of their neighbours in file-name order, so ties are settled as in an index
built anew, and searches of both give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.operators.bm25 import block_maxima
from lexifold.options import DEFAULTS, RetrievalOptions
from lexifold.plans.index import (
    BLOCK_COLUMNS, GAP_BITS, POSTING_COLUMNS, VERSION_SCHEMA, Counts, KnowledgeIndex, block_of, build_index, load_index, segment_counts,
    write_segment, write_summary,
)
from lexifold.sources.bucketed import write_bucketed
from lexifold.sources.scratch import broadcast_if_small, materialize, new_folder, shuffles_removed
from lexifold.sources.store import Store

# More segments than this are merged before another is written.
MAX_SEGMENTS = 16


class NoRoom(ValueError):
    """Neighbours in file-name order have too few numbers between them for the new documents; build the index anew."""


def number_between(taken: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` documents with ``doc_no`` between the numbers ``taken`` (file_name, doc_no) of their neighbours by file name.

    Both are sorted together by one range shuffle; what reaches over a range is known from one row for each range.
    """
    names = VERSION_SCHEMA.replace(",", "").split()[2::2]
    row = F.struct(*names).alias("row")
    nothing = F.lit(None).cast(fresh.select(row).schema["row"].dataType).alias("row")
    both = taken.select("file_name", "doc_no", nothing).unionByName(fresh.select("file_name", F.lit(None).cast("bigint").alias("doc_no"), row))
    order = ("file_name", F.col("doc_no").isNull(), "doc_no")  # a new version comes after the former one
    ranged = both.repartitionByRange("file_name", F.col("doc_no").isNull(), "doc_no").sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "numbers")

    # By range: the first and last taken number, and the new documents before the first, after the last, and in all.
    so_far = Window.partitionBy("part").orderBy("place")
    new = F.col("doc_no").isNull().cast("bigint")
    counted = placed.withColumn("new_before", F.sum(new).over(so_far) - new).withColumn("rank_in_part", F.sum(new).over(so_far))
    ends = counted.groupBy("part").agg(
        F.min("doc_no").alias("first_no"), F.max("doc_no").alias("last_no"),
        F.min(F.when(F.col("doc_no").isNotNull(), F.col("new_before"))).alias("before_first"),
        F.max(F.when(F.col("doc_no").isNotNull(), F.col("new_before"))).alias("before_last"),
        F.sum(new).alias("new_in_part"),
    ).collect()
    ends = {r["part"]: r for r in ends}
    low, high, total = {}, {}, 0  # what the ranges before and after know: (number, new documents before it)
    known, start = (0, 0), {}
    for part in sorted(ends):
        start[part], low[part] = total, known
        if ends[part]["last_no"] is not None:
            known = (ends[part]["last_no"], total + ends[part]["before_last"])
        total += ends[part]["new_in_part"]
    known = (None, total)
    for part in sorted(ends, reverse=True):
        high[part] = known
        if ends[part]["first_no"] is not None:
            known = (ends[part]["first_no"], start[part] + ends[part]["before_first"])
    rows = [(p, start[p], *low[p], *high[p]) for p in sorted(ends)]
    spark = taken.sparkSession
    edges = F.broadcast(spark.createDataFrame(rows, "part int, part_start bigint, low_no bigint, low_new bigint, high_no bigint, high_new bigint"))

    at = F.when(F.col("doc_no").isNotNull(), F.struct("doc_no", (F.col("part_start") + F.col("new_before")).alias("new")))
    # The next taken number is the last one seen backwards: a frame up to the end would be gone through anew for each row.
    backwards = Window.partitionBy("part").orderBy(F.desc("place"))
    near = counted.join(edges, "part").withColumn("at", at)
    near = near.withColumn("lo", F.last("at", ignorenulls=True).over(so_far)).withColumn("hi", F.last("at", ignorenulls=True).over(backwards))
    near = near.where("doc_no is null").select(
        "row",
        F.coalesce("lo.doc_no", "low_no").alias("lo"), F.coalesce("lo.new", "low_new").alias("lo_new"),
        F.coalesce("hi.doc_no", "high_no").alias("hi"), F.coalesce("hi.new", "high_new").alias("hi_new"),
        (F.col("part_start") + F.col("rank_in_part")).alias("rank"),
    )
    step = F.when(F.col("hi").isNull(), F.lit(1 << GAP_BITS)).otherwise(F.expr("(hi - lo) div (hi_new - lo_new + 1)"))
    return near.select((F.col("lo") + (F.col("rank") - F.col("lo_new")) * step).alias("doc_no"), step.alias("step"), "row.*")


def update_index(
    index: KnowledgeIndex, store: Store, changed: DataFrame, model: str | None = None, path: str | None = None,
    options: RetrievalOptions = DEFAULTS,
) -> KnowledgeIndex:
    """``index`` brought in line with ``store``, of which only the documents ``changed`` (source_id) differ from it.

    ``changed``: added, updated and removed documents, for instance ``plan.where("action <> 'unchanged'")`` of an ingest,
    and those whose vectors are new. Repeated ids count once; an id that neither side has changes nothing.
    """
    spark = index.versions.sparkSession
    if len(index.segments) >= MAX_SEGMENTS:
        index = merge_segments(index)
    path = path or new_folder(spark, "segment")
    changed = materialize(changed.select("source_id").where("source_id is not null").distinct(), "changed")
    dead = materialize(index.versions.join(changed, "source_id", "left_semi").select("doc_no"), "dead")
    n_dead = dead.count()
    taken = [spark.read.schema(VERSION_SCHEMA).parquet(f"{folder}/versions").select("file_name", "doc_no") for folder in index.segments]
    fresh = store.documents.join(changed, "source_id", "left_semi")
    numbered = materialize(number_between(reduce(DataFrame.union, taken), fresh), "fresh")
    narrow = numbered.where("step < 1").agg(F.min("file_name")).first()[0]
    if narrow is not None:
        raise NoRoom(narrow)
    n_fresh = numbered.count()
    written = write_segment(store, numbered.drop("step"), path, index.buckets, len(index.segments))

    # Rows of the dead lie in buckets by number: few are named to the readers or sent to them, many are joined where they lie.
    write_bucketed(dead.repartition(index.buckets, "doc_no"), f"{path}/dead", index.buckets)
    near = index.near(dead, n_dead, options)
    gone = broadcast_if_small(dead, n_dead, options.max_broadcast_rows)
    chunks, postings = near.chunks.join(gone, "doc_no", "left_semi"), near.postings.join(gone, "doc_no", "left_semi")
    taken_back = postings.groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
    with shuffles_removed(spark):
        taken_back.write.mode("append").parquet(f"{path}/terms")

    segments = (*index.segments, path)
    if model != index.embedding_model:  # which vectors count has changed for all documents
        old = segment_counts(spark, index.chunks, index.postings, model)
    else:
        old = Counts(index.n_chunks, index.n_usable, index.n_terms)
    less, more = segment_counts(spark, chunks, postings, model), segment_counts(spark, written.chunks, written.postings, model)
    counts = Counts(*(getattr(old, f) - getattr(less, f) + getattr(more, f) for f in ("n_chunks", "n_usable", "n_terms")))
    n_documents = index.n_documents - n_dead + n_fresh
    write_summary(spark, path, n_documents, counts, model, index.buckets, index.n_dead + n_dead, segments)
    return load_index(spark, path, options)


def merge_segments(index: KnowledgeIndex, path: str | None = None) -> KnowledgeIndex:
    """The live rows of all segments as one segment; no text is read for its words again, numbers stay."""
    spark = index.versions.sparkSession
    path = path or new_folder(spark, "merged")
    index.versions.select(*VERSION_SCHEMA.replace(",", "").split()[0::2]).write.parquet(f"{path}/versions")
    write_bucketed(index.chunks.sortWithinPartitions("doc_no", "chunk_order"), f"{path}/chunks", index.buckets)
    names = POSTING_COLUMNS.replace(",", "").split()[0::2]
    postings = index.postings.select(*names)
    write_bucketed(postings.sortWithinPartitions("term"), f"{path}/postings", index.buckets)
    maxima = block_maxima(postings.withColumn("block", block_of(F.col("doc_no"), index.buckets, 0)))
    maxima.select(*BLOCK_COLUMNS.replace(",", "").split()[0::2]).sortWithinPartitions("term").write.parquet(f"{path}/blocks")
    index.terms.orderBy("term").write.parquet(f"{path}/terms")
    counts = Counts(index.n_chunks, index.n_usable, index.n_terms)
    write_summary(spark, path, index.n_documents, counts, index.embedding_model, index.buckets, 0, (path,))
    return load_index(spark, path)


def refresh_index(index: KnowledgeIndex, store: Store, changed: DataFrame, model: str | None = None, path: str | None = None) -> KnowledgeIndex:
    """``update_index``, or a new build where the numbers between neighbours are used up."""
    try:
        return update_index(index, store, changed, model, path)
    except NoRoom:
        return build_index(store, model, None, index.buckets)
