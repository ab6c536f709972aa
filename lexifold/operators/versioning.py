"""Which version of a document counts, and what is done about the others."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions.versions import discard_reason, in_effect, version_key
from lexifold.sources.scratch import materialize


def current_versions(versions: DataFrame, as_of: datetime.date) -> DataFrame:
    """One row per family: ``document_key, n_versions, current`` (null when no version is in effect).

    An aggregate, not a window: a family that holds a third of all documents is
    still combined map-side. Newest date first, then highest version, then
    catalogue order.
    """
    key = version_key(F.col("version"))
    precedence = F.struct(
        F.datediff(F.lit("1970-01-01").cast("date"), F.col("effective_date")),
        F.transform(key, lambda part: -part),
        F.col("file_name"),
    )
    usable = in_effect(F.col("status"), F.col("effective_date"), as_of)
    current = F.struct("source_id", "title", "version", "effective_date")
    return versions.groupBy("document_key").agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.min_by(F.when(usable, current), F.when(usable, precedence)).alias("current"),
    )


@dataclass(frozen=True)
class Resolution:
    """``hits``: every candidate with its verdict. The other frames are views of it, keyed by ``query_id``."""

    hits: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.hits.where("kept")

    @property
    def selected(self) -> DataFrame:
        """The version in effect of each multi-version family met, in order of first appearance."""
        return (
            self.hits.where(F.col("multi_version") & F.col("current").isNotNull())
            .groupBy("query_id", "document_key")
            .agg(F.min("rank").alias("first_rank"), F.first("current").alias("current"))
            .select("query_id", "document_key", "first_rank", "current.*")
        )

    @property
    def discarded(self) -> DataFrame:
        return (
            self.hits.where(~F.col("kept"))
            .groupBy("query_id", "source_id")
            .agg(
                F.min("rank").alias("first_rank"),
                *[F.first(c).alias(c) for c in ("document_key", "title", "version", "effective_date", "reason")],
            )
        )

    @property
    def needs_substitution(self) -> DataFrame:
        """Families whose version in effect was not retrieved: ``replaced_rank`` is where its sections go."""
        return (
            self.hits.where(F.col("needs_substitution"))
            .groupBy("query_id", "document_key")
            .agg(F.min("rank").alias("replaced_rank"), F.first("current.source_id").alias("source_id"))
        )


def version_intervals(versions: DataFrame) -> DataFrame:
    """``document_key, valid_from, valid_to, current``: which version of a family is in effect from one day to before another.

    The best version of each day on which one comes into effect is an aggregate, so what is sorted of a family has a
    row for each such day, however many documents the family has. The last interval has no end.
    """
    precedence = F.struct(F.transform(version_key(F.col("version")), lambda part: -part), F.col("file_name"))
    current = F.struct("source_id", "title", "version", "effective_date")
    usable = versions.where((F.col("status") != "superseded") & F.col("effective_date").isNotNull())
    days = usable.groupBy("document_key", F.col("effective_date").alias("valid_from")).agg(F.min_by(current, precedence).alias("current"))
    following = Window.partitionBy("document_key").orderBy("valid_from")
    return days.withColumn("valid_to", F.lead("valid_from").over(following)).select("document_key", "valid_from", "valid_to", "current")


def versions_on(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """``asked`` (document_key, as_of; distinct) with ``n_versions, current``: the family's version in effect on each day.

    An interval join: intervals are split by the years that are asked about, so the equal keys of the join are a family
    and a year, and one with many versions and many questions is spread over its years. A null day has no version in effect.
    """
    sizes = versions.groupBy("document_key").agg(F.count(F.lit(1)).alias("n_versions"))
    first, last = asked.agg(F.min(F.year("as_of")), F.max(F.year("as_of"))).first()
    if first is None:
        first, last = 1, 0
    intervals = version_intervals(versions)
    begin, end = F.year("valid_from"), F.year(F.date_sub(F.col("valid_to"), 1))
    begin, end = F.greatest(begin, F.lit(first)), F.least(F.coalesce(end, F.lit(last)), F.lit(last))
    years = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
    intervals = materialize(intervals.withColumn("year", F.explode(years)), "intervals")
    on = ["document_key", "year"]
    met = asked.withColumn("year", F.year("as_of")).join(intervals, on).where(
        (F.col("as_of") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to")))
    )
    found = met.select("document_key", "as_of", "current")
    same = asked.alias("a").join(found.alias("f"), (F.col("a.document_key") == F.col("f.document_key")) & F.col("a.as_of").eqNullSafe(F.col("f.as_of")), "left")
    return same.select("a.document_key", "a.as_of", "f.current").join(sizes, "document_key", "left")


def resolve_versions(hits: DataFrame, versions: DataFrame, as_of: datetime.date | None) -> Resolution:
    """``hits``: ``query_id, rank, source_id, document_key, title, version, effective_date, ...``.

    A single-version document passes, even a superseded one. In a family of
    several versions only the one in effect is kept: on the day ``as_of``, or
    without one on the day in the column ``as_of`` of the hits.
    """
    # Only families that were met are resolved; the hits are the small side of this join.
    met_keys = hits.select("document_key").distinct()
    met_versions = versions.join(met_keys, "document_key", "left_semi")
    if as_of is None:
        asked = materialize(hits.select("document_key", "as_of").distinct(), "asked-days")
        families = materialize(versions_on(asked, met_versions), "families").withColumnRenamed("document_key", "of_key").withColumnRenamed("as_of", "of_day")
        met = hits.join(families, (F.col("document_key") == F.col("of_key")) & F.col("as_of").eqNullSafe(F.col("of_day")), "left").drop("of_key", "of_day")
        day = F.col("as_of")
    else:
        families = materialize(current_versions(met_versions, as_of), "families")
        met, day = hits.join(families, "document_key", "left"), F.lit(as_of)
    multi = F.coalesce(F.col("n_versions") > 1, F.lit(False))
    kept = ~multi | F.coalesce(F.col("source_id") == F.col("current.source_id"), F.lit(False))
    judged = met.withColumn("multi_version", multi).withColumn("kept", kept)
    per_family = Window.partitionBy("query_id", "document_key")
    reason = discard_reason(F.col("effective_date"), F.col("current.version"), F.col("current.effective_date"), day)
    return Resolution(
        judged.withColumn("reason", F.when(~F.col("kept"), reason)).withColumn(
            "needs_substitution",
            F.col("multi_version") & F.col("current").isNotNull() & ~F.max("kept").over(per_family),
        )
    )
