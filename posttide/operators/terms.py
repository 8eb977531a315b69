"""Term and n-gram counts, vocabulary, bag of words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.functions import text
from posttide.session import materialize

# Settings of the topic model's vocabulary.
MIN_DF, MAX_TERMS = 3, 5000
#: Sizes of the summaries of frequent n-grams that are tried; the most that one may hold; how many are merged at once.
TRACKED = (1 << 14, 1 << 17)
MOST_TRACKED = 1_000_000
SUMMARIES = 256
#: Text whose n-grams one task counts.
PIECE_BYTES = 16 << 20


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row.

    A lambda variable is bound to its value, while a column named in a lambda
    would be worked out again for every element.
    """
    return F.transform(F.array(value), use)[0]


def ngram_column(tokens: Column, n: int = 2) -> Column:
    """Runs of `n` neighbouring tokens joined by a blank; none for shorter lists."""
    def runs(words: Column) -> Column:
        starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda first, i: F.concat_ws(
            " ", first, *[F.get(words, i + k) for k in range(1, n)]))

    return once(tokens, runs)


def _joined(df: DataFrame, column: str) -> Column:
    """A text column, or a token list joined by blanks."""
    is_list = dict(df.dtypes)[column].startswith("array")
    return F.array_join(column, " ") if is_list else F.col(column)


def ngrams(df: DataFrame, n: int = 2, column: str = "text", name: str = "ngrams") -> DataFrame:
    """Add the n-grams of a text, or of a token list joined by blanks."""
    return df.withColumn(name, ngram_column(text.words(_joined(df, column)), n))


def ngram_rows(df: DataFrame, n: int = 2, column: str = "text") -> DataFrame:
    """(ngram), a row for every n-gram of the texts.

    A text emits its words with their places, and each puts the ones after it behind itself: in compiled code, which a
    lambda over the list is not. The outer form is used, and its row for an empty list dropped, as in `term_stats`.
    """
    each = (df.select(text.words(_joined(df, column)).alias("words"))
            .select("words", F.posexplode_outer("words").alias("i", "first")))
    after = [F.get("words", F.col("i") + k) for k in range(1, n)]
    return (each.where(F.col("i") <= F.size("words") - n)
            .select(F.concat_ws(" ", "first", *after).alias("ngram")))


def ngram_counts(df: DataFrame, n: int = 2, column: str = "text") -> DataFrame:
    """(ngram, n) over all texts; counts are combined before the shuffle.

    Almost every run of words may be a new one, so a task holds a count for each: rows are dealt to tasks of about
    `PIECE_BYTES` of text, however large the table.
    """
    words = _joined(df, column)
    size = df.agg(F.sum(F.octet_length(words))).first()[0] or 0
    pieces = max(-(-size // PIECE_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.select(words.alias("text"), F.xxhash64(*df.columns).alias("_deal")).repartition(pieces, "_deal")
    return ngram_rows(dealt, n).groupBy("ngram").agg(F.count("*").alias("n"))


def frequent(df: DataFrame, column: str, tracked: int) -> tuple[DataFrame, float]:
    """Values that may be frequent, and a bound: any other value occurs at most that often.

    Every task keeps a summary of at most `tracked` values; summaries are merged in two steps, and no other value is
    shuffled. A summary of `tracked` values out of n misses none that occurs more than 3.5 n / tracked times.
    """
    if not 0 < tracked <= MOST_TRACKED:
        raise ValueError(f"between 1 and {MOST_TRACKED} values can be tracked")
    partial = df.groupBy((F.spark_partition_id() % SUMMARIES).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(`{column}`, {tracked})").alias("summary"), F.count("*").alias("n"))
    # A group of its own, not a global aggregate: without any value there is no summary to merge.
    merged = partial.groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"), F.sum("n").alias("n"))
    estimate = F.expr(f"approx_top_k_estimate(summary, {tracked})").alias("top")
    found = materialize(merged.select("n", estimate), "frequent")
    total = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return found.select(F.explode("top.item").alias(column)), 3.5 * total / tracked


def top_ngrams(df: DataFrame, n: int = 2, k: int = 10, column: str = "text",
               tracked: Sequence[int] = TRACKED) -> DataFrame:
    """The `k` most frequent n-grams with their exact counts, ties by the n-gram.

    A summary of frequent n-grams names candidates, which are then counted exactly: only they are shuffled. If the
    last of the top `k` does not occur more often than any other n-gram can, a larger summary is tried; after the
    last one, all n-grams are counted.
    """
    runs = ngram_rows(df, n, column)
    for size in tracked:
        candidates, bound = frequent(runs, "ngram", size)
        # At most `size` n-grams, so they are broadcast.
        counted = runs.join(F.broadcast(candidates), "ngram").groupBy("ngram").agg(F.count("*").alias("n"))
        best = materialize(counted.orderBy(F.desc("n"), "ngram").limit(k), "top-ngrams")
        found, least = best.agg(F.count("*"), F.min("n")).first()
        if bound < 1 or (found == k and least > bound):
            return best.orderBy(F.desc("n"), "ngram")
    return ngram_counts(df, n, column).orderBy(F.desc("n"), "ngram").limit(k)


def topic_words(df: DataFrame, column: str = "text", name: str = "tokens") -> DataFrame:
    """Add the topic model's tokens of a text or token list."""
    return df.withColumn(name, text.words(_joined(df, column), text.TOPIC_WORD))


def term_stats(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, term_freq, doc_freq); one row of `df` is one document.

    A document emits its tokens in order; one that differs from the token before it is the first of its kind. So both
    counts come out of one aggregation that combines before the shuffle, and no (term, document) pair is shuffled.
    The outer form is used, and its row for an empty list dropped: for a named list column the other one would add a
    filter on its size, and sort the list a second time for it.
    """
    each = (df.select(F.sort_array(tokens).alias("sorted"))
            .select("sorted", F.posexplode_outer("sorted").alias("i", "term")).where(F.col("i").isNotNull()))
    first = (F.col("i") == 0) | ~F.col("term").eqNullSafe(F.get("sorted", F.col("i") - 1))
    return each.groupBy("term").agg(F.count("*").alias("term_freq"), F.count_if(first).alias("doc_freq"))


def vocabulary(df: DataFrame, min_df: int = MIN_DF, max_terms: int = MAX_TERMS,
               tokens: str = "tokens") -> DataFrame:
    """The `max_terms` most frequent terms in at least `min_df` documents."""
    return (term_stats(df, tokens).where(F.col("doc_freq") >= min_df)
            .orderBy(F.desc("term_freq"), "term").limit(max_terms))


def term_list(vocab: DataFrame) -> list[str]:
    """The vocabulary as a list, most frequent first: at most `max_terms` words."""
    return [r["term"] for r in vocab.orderBy(F.desc("term_freq"), "term").select("term").collect()]


def bag_of_words(df: DataFrame, terms: list[str], tokens: str = "tokens",
                 name: str = "features") -> DataFrame:
    """Add sparse count vectors over `terms` and the number of counted tokens, `n_terms`."""
    if not terms:
        raise ValueError("the vocabulary is empty")
    model = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol=name)
    counts = F.unwrap_udt(name)["values"]
    total = F.aggregate(counts, F.lit(0.0), lambda total, n: total + n).cast("bigint")
    return model.transform(df).withColumn("n_terms", total)


def bag_rows(bags: DataFrame, terms: list[str], key: str, name: str = "features") -> DataFrame:
    """(key, term, n) of every bag; a bag without any term is one row without term and n 0.

    The vocabulary has at most as many rows as its limit, so it is broadcast.
    """
    places = bags.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    vector = F.unwrap_udt(name)
    each = bags.select(key, F.explode_outer(F.arrays_zip(vector["indices"].alias("place"),
                                                         vector["values"].alias("n"))).alias("e"))
    return (each.select(key, F.col("e.place").alias("place"), F.col("e.n").alias("n"))
            .join(F.broadcast(places), "place", "left")
            .select(key, "term", F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n")))
