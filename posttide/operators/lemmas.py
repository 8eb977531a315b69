"""Lemmas from a lexicon table and suffix rules.

A lexicon row is (surface, pos, lemma, freq) with pos n, v or a. It is a table
the caller brings; without one, tokens stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posttide.functions import text
from posttide.operators.joins import lookup_join
from posttide.session import materialize

# Word class, ending of the inflected form, ending of the lemma.
SUFFIX_RULES = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "ves", "f"), ("n", "xes", "x"), ("n", "zes", "z"),
    ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"),
    ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]


def tag_tokens(lexicon: DataFrame) -> DataFrame:
    """Class and lemma per surface form: its most frequent reading, then pos, then lemma."""
    reading = F.struct(-F.col("freq"), F.col("pos"), F.col("lemma"))
    return (lexicon.where("surface is not null and lemma is not null")
            .groupBy("surface").agg(F.min_by(F.struct("pos", "lemma"), reading).alias("r"))
            .select(F.col("surface").alias("token"), "r.pos", "r.lemma"))


def lemma_forms(lexicon: DataFrame) -> DataFrame:
    """Every form that can be looked up, with its lemma: (token, lemma).

    The suffix rules run backwards, from the lemmas to the forms they explain,
    so the table is at most (rules + 1) times the lexicon, whatever the texts
    hold. Listed surface forms win over rules, earlier rules over later ones.
    """
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(pos).alias("rule_pos"),
                               F.lit(ending).alias("ending"), F.lit(base).alias("base"))
                      for i, (pos, ending, base) in enumerate(SUFFIX_RULES)])
    stem = F.expr("left(lemma, length(lemma) - length(r.base))")
    derived = (lexicon.where("lemma is not null").select("lemma", "pos").distinct()
               .select("lemma", "pos", F.explode(rules).alias("r"))
               .where((F.col("pos") == F.col("r.rule_pos")) & F.endswith("lemma", F.col("r.base")))
               .select(F.concat(stem, F.col("r.ending")).alias("token"), "r.rule", "lemma"))
    listed = tag_tokens(lexicon).select("token", F.lit(-1).alias("rule"), "lemma")
    return (listed.unionByName(derived)
            .groupBy("token").agg(F.min(F.struct("rule", "lemma")).alias("best"))
            .select("token", "best.lemma"))


def lemmatize(df: DataFrame, lexicon: DataFrame | None, tokens: str = "tokens",
              key: str = "row_key") -> DataFrame:
    """Replace known tokens by their lemmas; order, repeats and unknown tokens stay.

    `key` identifies a row. Only the distinct tokens of a row that do change
    travel: they come back as a small map per row, applied to its token list.
    The rows are used twice, so they are written first: what leads to the tokens
    is worked out once.
    """
    if lexicon is None:
        return df
    df = materialize(df, "tokens")
    forms = materialize(lemma_forms(lexicon).where("token <> lemma"), "lemma-forms")
    distinct = df.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    changes = (lookup_join(distinct, forms, ["token"], "inner").groupBy(key)
               .agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas")))
    joined = df.join(changes, key, "left")
    replaced = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return joined.withColumn(
        tokens, F.when(F.col("_lemmas").isNull(), F.col(tokens)).otherwise(replaced)).drop("_lemmas")


def heavy_tokens(c: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Heavily cleaned text as tokens without stop words, before lemmas."""
    words = text.STOPWORDS if stopwords is None else stopwords
    return text.heavy_words(c, words)


def clean_heavy(df: DataFrame, lexicon: DataFrame | None = None,
                stopwords: Sequence[str] | None = None, column: str = "text",
                key: str = "row_key") -> DataFrame:
    """Replace a text column by its cleaned, stop-word-free, lemmatised tokens."""
    tokens = df.withColumn(column, heavy_tokens(F.col(column), stopwords))
    return lemmatize(tokens, lexicon, column, key)
