"""Expressions on document versions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the reasons a version is discarded for.
REASON_FUTURE = "Yürürlük tarihi (%s) henüz gelmedi."
REASON_NO_CURRENT = "Bu dokümanın yürürlükte bir sürümü yok."
REASON_SUPERSEDED = "%s sürümü (%s) tarafından geçersiz kılındı."


def version_key(version: Column) -> Column:
    """Sort key of a dotted version: four integers, absent parts -1; unparseable counts as 0.0.

    1.9 < 1.10 and 1.9 < 1.9.0, as arrays compare element by element.
    """
    parts = F.transform(F.split(version, r"\."), lambda part: part.try_cast("int"))
    readable = version.rlike(r"^\d+(\.\d+){1,3}$") & ~F.exists(parts, lambda part: part.isNull())
    padded = F.slice(F.concat(parts, F.array(F.lit(-1), F.lit(-1))), 1, 4)
    return F.when(readable, padded).otherwise(F.array(F.lit(0), F.lit(0), F.lit(-1), F.lit(-1)))


def in_effect(status: Column, effective_date: Column, as_of: datetime.date) -> Column:
    return (status != "superseded") & (effective_date <= F.lit(as_of))


def discard_reason(
    effective_date: Column, current_version: Column, current_date: Column, as_of: datetime.date | Column
) -> Column:
    """A future date is named first, then a family without a version in effect, then the version that replaced it."""

    def iso(date: Column) -> Column:
        return F.date_format(date, "yyyy-MM-dd")

    return (
        F.when(effective_date > F.lit(as_of), F.format_string(REASON_FUTURE, iso(effective_date)))
        .when(current_version.isNull(), F.lit(REASON_NO_CURRENT))
        .otherwise(F.format_string(REASON_SUPERSEDED, current_version, iso(current_date)))
    )
