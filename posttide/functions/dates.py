"""Timestamps and dates read from text; what does not parse is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def post_time(c: Column) -> Column:
    """The part before the first dot as `yyyy-MM-dd HH:mm:ss`; one-digit parts are accepted."""
    return F.try_to_timestamp(F.split_part(c, F.lit("."), F.lit(1)), F.lit("yyyy-M-d H:m:s"))


def post_month(c: Column) -> Column:
    """Month label `yyyy_MM` of a timestamp text."""
    return F.date_format(post_time(c), "yyyy_MM")


def post_date(c: Column) -> Column:
    """Date in the first ten characters."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-M-d")


def month_of(d: Column) -> Column:
    """First day of the month of a date."""
    return F.trunc(d, "month")
