"""One-sample t-tests per group and for fold accuracies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.functions.tdist import t_critical, t_pvalue
from posttide.operators import sentiment

NAN = float("nan")


def t_statistic(mean: Column, sd: Column, n: Column, popmean: float) -> Column:
    """(mean - popmean) / (sd / sqrt(n)); NaN without spread information, infinite without spread."""
    gap = mean - F.lit(float(popmean))
    endless = (F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
               .otherwise(F.lit(NAN)))
    return (F.when(mean.isNull() | sd.isNull() | F.isnan(mean) | F.isnan(sd), F.lit(NAN))
            .when(sd == 0, endless)
            .otherwise(F.try_divide(gap, F.try_divide(sd, F.sqrt(n)))))


def ttest_1samp(df: DataFrame, group: Sequence[str], value: str, popmean: float = 0.5,
                nulls: str = "propagate", extra: Sequence[Column] = ()) -> DataFrame:
    """Per group: n, mean, t and the two-sided p of the mean against `popmean`.

    One aggregation for all groups. With `nulls="propagate"` a NULL value makes
    the test of its group undefined (NaN); `"omit"` leaves NULL values out.
    """
    if nulls not in ("propagate", "omit"):
        raise ValueError(f"nulls must be 'propagate' or 'omit', not {nulls!r}")
    v = F.col(value).cast("double")
    stats = df.groupBy(*group).agg(
        F.count("*").alias("n_posts"), F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("_sd"), *extra)
    if nulls == "propagate":
        hole = F.col("n") < F.col("n_posts")
        stats = stats.withColumn("mean", F.when(hole, F.lit(NAN)).otherwise(F.col("mean")))
    t = t_statistic(F.col("mean"), F.col("_sd"), F.col("n"), popmean)
    return stats.withColumn("t", t).drop("_sd")


def with_pvalue(tested: DataFrame) -> DataFrame:
    """Add `p`; the only Python in the test, on one row per group."""
    p = t_pvalue(F.col("t"), (F.col("n") - 1).cast("double"))
    return tested.withColumn("p", F.coalesce(p, F.lit(NAN)))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    """`Accept` from alpha on, else `Reject`; an undefined p is a `Reject`."""
    undefined = p.isNull() | F.isnan(p)
    return F.when(undefined, "Reject").when(p >= alpha, "Accept").otherwise("Reject")


def sentiment_bias_test(df: DataFrame, k: int = sentiment.TOP_COUNTRIES, popmean: float = 0.5,
                        nulls: str = "propagate", alpha: float = 0.05) -> DataFrame:
    """Test the mean sign of the `k` countries with most posts, most posts first.

    `p` keeps the unrounded p-value that verdict and `rejected_ratio` rest on.
    """
    signed = sentiment.with_sign(df).where(F.col("country").isNotNull())
    negatives = F.count_if(F.col("sign") == -1).alias("_negatives")
    tested = ttest_1samp(signed, ["country"], "sign", popmean, nulls, [negatives])
    top = with_pvalue(sentiment.top_k(tested, k))
    return top.orderBy(F.desc("n_posts"), "country").select(
        F.col("country").alias("Country"),
        F.bround(F.col("_negatives") / F.col("n_posts"), 2).alias("Negative Sentiment Ratio"),
        rounded(F.col("t")).alias("t-statistic"),
        rounded(F.col("p")).alias("p-value"),
        verdict(F.col("p"), alpha).alias("Null Hypothesis"),
        "p")


def rounded(c: Column, digits: int = 2) -> Column:
    """Half-even rounding that lets NaN and infinities through."""
    plain = ~(F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(plain, F.bround(F.when(plain, c), digits)).otherwise(c)


def rejected_ratio(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of tested groups with p below alpha, two decimals; undefined p does not count."""
    low = (F.col("p") < alpha) & ~F.isnan("p")
    return result.agg(F.bround(F.avg(F.coalesce(low, F.lit(False)).cast("int")), 2)
                      .alias("rejected_ratio"))


def accuracy_test(folds: DataFrame, baseline: float = 0.333, alpha: float = 0.05) -> DataFrame:
    """One-sided test of fold accuracies above `baseline`, with the population spread.

    One row: mean_accuracy, sd, n, t, critical, reject.
    """
    stats = folds.agg(F.avg("accuracy").alias("mean_accuracy"),
                      F.stddev_pop("accuracy").alias("sd"), F.count("accuracy").alias("n"))
    stats = stats.withColumn("t", t_statistic(F.col("mean_accuracy"), F.col("sd"), F.col("n"), baseline))
    critical = t_critical(F.lit(float(alpha)), (F.col("n") - 1).cast("double"))
    stats = stats.withColumn("critical", F.coalesce(critical, F.lit(NAN)))
    defined = ~(F.isnan("t") | F.isnan("critical"))
    return stats.withColumn("reject", defined & (F.col("t") > F.col("critical")))
