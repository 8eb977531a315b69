"""Raw posts to preprocessed posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.operators import lemmas, places, posts
from posttide.session import job_scratch, materialize
from posttide.sources import ledger, readers, writers

LIGHT, HEAVY = "light", "heavy"


def preprocess(raw: DataFrame, index: DataFrame, mode: str = LIGHT,
               lexicon: DataFrame | None = None, stopwords: Sequence[str] | None = None,
               lang: str = "en", case_insensitive: bool = False) -> DataFrame:
    """Posts with `file` and `pos` to preprocessed rows with `year_month`.

    The month of a file is read off all its rows, before the language filter.
    Filters come before text work, so only kept rows are cleaned.
    """
    if mode not in (LIGHT, HEAVY):
        raise ValueError(f"mode must be {LIGHT!r} or {HEAVY!r}, not {mode!r}")
    kept = posts.filter_valid_hashtags(posts.filter_language(readers.assign_file_month(raw), lang))
    located = places.resolve_location(kept, index, case_insensitive)
    if mode == LIGHT:
        return posts.build_preprocessed(located)
    if lexicon is not None and "row_key" not in located.columns:
        located = located.withColumn("row_key", F.struct("file", "pos"))
    built = posts.build_preprocessed(located, lemmas.heavy_tokens(F.col("text"), stopwords))
    return lemmas.lemmatize(built, lexicon, "text", "row_key")


def run(spark: SparkSession, posts_path: str, gazetteer_path: str, out: str, mode: str = LIGHT,
        lexicon: DataFrame | None = None, fmt: str = "parquet", job: str | None = None, **options) -> None:
    """CSV folder to `out`/all and `out`/located, one folder per month each.

    The reader lands raw text once. The preprocessed rows are written once
    before the two sinks, so that cleaning and place lookup run once. All
    intermediate tables go when the job ends. With a `job` name the sinks are tables of `sources.ledger` (Parquet):
    the same job run again adds nothing.
    """
    if job and fmt != "parquet":
        raise ValueError("named jobs append to Parquet tables only")
    with job_scratch(spark):
        raw = readers.read_posts(spark, posts_path)
        gaz = readers.read_gazetteer(spark, gazetteer_path)
        index = materialize(places.build_place_index(gaz), "place-index")
        rows = materialize(preprocess(raw, index, mode, lexicon, **options), "preprocessed")
        if job:
            ledger.append_once(rows, f"{out}/all", job)
            ledger.append_once(posts.filter_located(rows), f"{out}/located", job)
            return
        writers.write_posts(rows, f"{out}/all", fmt)
        writers.write_located(rows, f"{out}/located", fmt)
