"""A pipeline over the documents table: language, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept, written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.llm import bpe, decontaminate, language, simhash, substring
from posttide.llm.queries import remainder
from posttide.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower pooled probability is rejected.
LEAST_LANGUAGE = 0.3


#: Rows that go to Python at once: documents are long, so fewer than Spark's own setting for short rows.
ROWS_AT_ONCE = 1000


def long_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, without any letter, or unlike all learned languages. Where nothing
    could be learned, only texts that are null or have no letter go."""
    long_rows(spark)
    model = language.fit(docs, remainder(3) != 1)
    if not model["languages"]:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    named = docs.select(*COLUMNS)
    found = language.identify(named, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (SimHash of three-word runs, 3 or fewer differing bits from one to the next)
    the document with the smallest id stays."""
    long_rows(spark)
    return simhash.keep_one_per_group(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 or more words that repeat are cut out; a document that loses words keeps the others, one
    space between them. Documents stay, even if nothing of their text does."""
    long_rows(spark)
    found = substring.remove_repeats(docs, keep=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark text go."""
    long_rows(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), benchmark)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text again. Ids are written before they are
    decoded: in one stage both would keep twice as many worker processes. A digest of each text goes with its ids, not
    the text."""
    long_rows(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    ids = materialize(bpe.encode(texts, ranks, public_tokenizers.PATTERN, keep=["doc_id", "digest"]), "ids")
    coded = bpe.decode(ids, ranks)
    same = F.sha2("decoded", 256) == F.col("digest")
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language", by_language),
    ("near-duplicates", near_duplicates),
    ("repeated-passages", repeated_passages),
    ("benchmark", benchmark_passages),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: language labels and fingerprints cannot be expressed there; tests hold the stages against brute force.
ORACLE_SQL = None
