"""Counters, scores and label recoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_count(c: Column) -> Column:
    """Text to bigint, NULL where it does not read as a whole number."""
    return c.try_cast("bigint")


def popularity_score(retweets: Column, favorites: Column) -> Column:
    """Retweets plus favorites; 0 when either is not a whole number."""
    return F.coalesce(F.try_add(to_count(retweets), to_count(favorites)), F.lit(0).cast("bigint"))


def reach_score(following: Column, followers: Column) -> Column:
    """Followers minus followed accounts, at least 0; 0 when either is not a whole number."""
    zero = F.lit(0).cast("bigint")
    surplus = F.try_subtract(to_count(followers), to_count(following))
    return F.greatest(F.coalesce(surplus, zero), zero)


def recode(c: Column, mapping: Mapping[str, int]) -> Column:
    """Replace each key by its value; anything else becomes NULL."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return F.lit(None) if out is None else out
