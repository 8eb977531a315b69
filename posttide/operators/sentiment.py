"""Counts and means of labelled posts per country and month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide import schemas
from posttide.functions import dates, scores
from posttide.operators import posts
from posttide.session import materialize

# How many countries a report holds.
TOP_COUNTRIES = 20

# Labels as numbers for the bias test.
SIGNS = {schemas.NEGATIVE: -1, schemas.POSITIVE: 1}


def _monthly(df: DataFrame, start: date, end: date, measures: dict[str, Column]) -> DataFrame:
    """One pass over the posts: every measure per country and month."""
    dated = posts.filter_dates(df, start, end).where(F.col("country").isNotNull())
    return (dated.groupBy("country", dates.month_of(F.col("date")).alias("month"))
            .agg(*[c.alias(name) for name, c in measures.items()]))


def _labelled(label: str) -> Column:
    return F.col("sentiment") == label


def _top(monthly: DataFrame, measure: str, k: int | None) -> DataFrame:
    totals = monthly.groupBy("country").agg(F.sum(measure).alias("n_posts"))
    return top_k(totals, k) if k is not None else totals


def top_k(totals: DataFrame, k: int = TOP_COUNTRIES) -> DataFrame:
    return totals.orderBy(F.desc("n_posts"), "country").limit(k)


def sentiment_counts(df: DataFrame, start: date = posts.PERIOD_START, end: date = posts.PERIOD_END,
                     k: int | None = TOP_COUNTRIES) -> DataFrame:
    """(country, month, Negative, Positive) counts, for the `k` countries with most labelled posts.

    The posts are read once; the ranking and its semi-join work on the monthly table.
    """
    monthly = _monthly(df, start, end, {
        "Negative": F.count_if(_labelled(schemas.NEGATIVE)),
        "Positive": F.count_if(_labelled(schemas.POSITIVE)),
    }).where("Negative + Positive > 0")
    if k is None:
        return monthly
    top = _top(monthly.withColumn("n", F.expr("Negative + Positive")), "n", k)
    return monthly.join(F.broadcast(top), "country", "left_semi")  # k rows


def sentiment_means(df: DataFrame, start: date = posts.PERIOD_START, end: date = posts.PERIOD_END,
                    k: int | None = TOP_COUNTRIES) -> DataFrame:
    """(country, month, Negative, Positive) mean scores, for the `k` countries with most posts.

    Posts without label count for the ranking; a label without scores in a month gives 0.
    The monthly table is written once: ranking and report need different columns of
    it, and would otherwise read the posts twice.
    """
    def mean(label: str) -> Column:
        return F.coalesce(F.avg(F.when(_labelled(label), F.col("sentiment_score"))), F.lit(0.0))

    monthly = _monthly(df, start, end, {
        "n": F.count("*"),
        "n_labelled": F.count_if(_labelled(schemas.NEGATIVE) | _labelled(schemas.POSITIVE)),
        "Negative": mean(schemas.NEGATIVE),
        "Positive": mean(schemas.POSITIVE),
    })
    if k is not None:
        monthly = materialize(monthly, "monthly-means")
    shown = monthly.where("n_labelled > 0")
    if k is not None:
        shown = shown.join(F.broadcast(_top(monthly, "n", k)), "country", "left_semi")  # k rows
    return shown.select("country", "month", "Negative", "Positive")


def country_totals(counts: DataFrame) -> DataFrame:
    """Labelled posts per country from a `sentiment_counts` table."""
    return counts.groupBy("country").agg(F.sum(F.expr("Negative + Positive")).alias("n_posts"))


def country_rows(df: DataFrame) -> DataFrame:
    """Posts per country, labelled or not."""
    return df.where(F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("n_posts"))


def top_countries(df: DataFrame, k: int = TOP_COUNTRIES) -> DataFrame:
    return top_k(country_rows(df), k)


def top_countries_labelled(df: DataFrame, k: int = TOP_COUNTRIES) -> DataFrame:
    known = df.where(F.col("sentiment").isin(schemas.NEGATIVE, schemas.POSITIVE))
    return top_k(country_rows(known), k)


def with_sign(df: DataFrame) -> DataFrame:
    return df.withColumn("sign", scores.recode(F.col("sentiment"), SIGNS))


def negative_ratio(df: DataFrame, digits: int = 2) -> DataFrame:
    """Share of negative posts among all posts of a country, rounded half to even."""
    share = F.count_if(F.col("sign") == -1) / F.count("*")
    return (with_sign(df).where(F.col("country").isNotNull())
            .groupBy("country").agg(F.bround(share, digits).alias("negative_ratio")))
