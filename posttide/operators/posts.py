"""Projections, filters and stacking of post tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide import schemas
from posttide.functions import dates, hashtags, scores, text
from posttide.operators.joins import lookup_join
from posttide.session import materialize

# The period the aggregates cover.
PERIOD_START, PERIOD_END = date(2022, 3, 1), date(2023, 4, 30)


def select_post_columns(df: DataFrame) -> DataFrame:
    return df.select(*schemas.POST_COLUMNS)


def filter_language(df: DataFrame, lang: str = "en") -> DataFrame:
    return df.where(F.col("language") == lang)


def filter_valid_hashtags(df: DataFrame, column: str = "hashtags") -> DataFrame:
    """Rows whose hashtag list can be read, with the list replaced by its texts."""
    return df.withColumn(column, F.explode(hashtags.readable(F.col(column))))


def filter_located(df: DataFrame) -> DataFrame:
    """Rows with a place; a NULL date stays, an empty one does not."""
    return df.where(F.col("lon").isNotNull() & (F.col("date").isNull() | (F.col("date") != "")))


def filter_dates(df: DataFrame, start: date = PERIOD_START, end: date = PERIOD_END,
                 column: str = "date") -> DataFrame:
    """Rows whose date lies in the period, both days whole; text is parsed, bad dates drop out."""
    day = F.col(column)
    if dict(df.dtypes)[column] == "string":
        day = dates.post_date(day)
    return df.withColumn(column, day).where(F.col(column).between(F.lit(start), F.lit(end)))


def filter_not_neutral(df: DataFrame) -> DataFrame:
    """Rows not labelled neutral; rows without label pass."""
    return df.where(~F.col("sentiment").eqNullSafe("neutral"))


def training_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(text, label) rows for a two-class model: positive 1, negative 0, others dropped."""
    label = scores.recode(F.col("sentiment"), {"positive": 1, "negative": 0}).alias("label")
    return filter_not_neutral(df).select(*keep, "text", label).where(F.col("label").isNotNull())


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("country",)) -> DataFrame:
    """Rows whose key is in `keys`; `keys` is measured before it is broadcast."""
    return lookup_join(df, materialize(keys.select(*on).distinct(), "keys"), on, "left_semi")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; missing columns become NULL, repeats stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def build_preprocessed(df: DataFrame, text_column: Column | None = None) -> DataFrame:
    """Located raw posts to the preprocessed layout: place fields, counters, scores.

    Expects a `place` struct and `hashtags` as an array. `text_column` is the
    cleaned text (light cleaning of `text` by default).
    """
    count = scores.to_count
    place = {f: F.col(f"place.{f}") for f in ("city", "state", "country", "lat", "lon")}
    for name in ("city", "state", "country"):
        place[name] = F.nullif(place[name], F.lit(""))
    known = {
        **place,
        "date": F.col("tweetcreatedts"),
        "text": text.clean_light(F.col("text")) if text_column is None else text_column,
        "hashtags": F.col("hashtags"),
        "following": count(F.col("following")),
        "followers": count(F.col("followers")),
        "total_tweets": count(F.col("totaltweets")),
        "retweet_count": count(F.col("retweetcount")),
        "favorite_count": count(F.col("favorite_count")),
        "reach_score": scores.reach_score(F.col("following"), F.col("followers")),
        "popularity_score": scores.popularity_score(F.col("retweetcount"), F.col("favorite_count")),
    }
    carried = [c for c in ("year_month", "file", "pos", "row_key") if c in df.columns]
    return df.select(*carried, *[c.alias(name) for name, c in known.items()])
