"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_day_year(x: Column) -> Column:
    """Parse month-day-year with dashes, slashes, dots or blanks; bad text gives NULL."""
    dashed = F.regexp_replace(F.trim(x), r"[/.\s]+", "-")
    return F.try_to_timestamp(dashed, F.lit("M-d-yyyy")).cast("date")


def year_of(x: Column) -> Column:
    return F.year(x).cast("long")


def month_no(x: Column) -> Column:
    return F.month(x).cast("long")


def month_name(x: Column) -> Column:
    return F.date_format(x, "MMM")


def month_rank(name: Column) -> Column:
    """Calendar position of a month label, NULL when it is not one."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0))
