"""Writers: one folder per month (and country), ids that go on where the last run ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide import schemas
from posttide.operators.posts import filter_located
from posttide.operators.ranking import assign_ids
from posttide.session import materialize

ROWS_PER_FILE = 5_000_000
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")

# CSV as Python's csv module writes it, blanks kept.
CSV_OPTIONS = {"header": True, "escape": '"', "nullValue": "", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def last_ids(df: DataFrame, path: str, fmt: str = "parquet", by: str = "year_month") -> DataFrame | None:
    """Highest id already stored under `path` for each month that `df` has; None when nothing is stored.

    Only the folders of those months are read. Whatever else keeps the stored
    table from being read is an error: ids would start anew.
    """
    reader = df.sparkSession.read
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    try:
        stored = reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_STORED:
            return None
        raise
    if "id" not in stored.columns:
        raise ValueError(f"the table under {path} has no ids to go on from")
    months = [r[0] for r in df.select(by).distinct().collect()]  # as many as the batch has folders
    month, last = F.col(by).cast("string"), F.max(F.col("id").cast("bigint")).alias("last_id")
    return materialize(stored.where(month.isin(months)).groupBy(month.alias(by)).agg(last), "last-ids")


def serialise_lists(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, for sinks that hold no arrays."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in lists}) if lists else df


def _append(df: DataFrame, path: str, parts: Sequence[str], fmt: str) -> None:
    out = serialise_lists(df) if fmt == "csv" else df
    writer = (out.write.mode("append").partitionBy(*parts)
              .option("maxRecordsPerFile", ROWS_PER_FILE))
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def write_posts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append preprocessed posts, numbered per month; needs `year_month`, `file`, `pos`.

    Numbering leaves the rows spread by month, file and block of rows, so a
    month of any size is written by many tasks and a task meets few months.
    """
    numbered = assign_ids(df, start=last_ids(df, path, fmt))
    carried = [c for c in numbered.columns if c in schemas.LABELLED_TYPES]
    ordered = [c for c in schemas.PREPROCESSED_COLUMNS if c in carried]
    _append(numbered.select(*ordered, "year_month"), path, ["year_month"], fmt)


def write_located(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append the located posts to their own table, with ids of their own."""
    write_posts(filter_located(df), path, fmt)


def write_labelled(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append labelled posts, one folder per month; rebalanced, so that a month has few files, and a large one many."""
    _append(df.hint("rebalance", "year_month"), path, ["year_month"], fmt)


def write_by_country(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append posts, one folder per country and month.

    Rows of a folder are brought together so that few files arise. Rebalancing
    by the folder keys lets adaptive execution split a country that holds a
    third of all posts over many tasks, and merge small folders into one.
    """
    parts = ["country", "year_month"]
    _append(df.where(F.col("country").isNotNull()).hint("rebalance", *parts), path, parts, fmt)


def write_gazetteer(df: DataFrame, path: str) -> None:
    """The gazetteer columns as CSV with header, in a stable order: by `row_id` if there is one, else by all columns.

    Files and rows are in that order, so the reader numbers the rows the same way.
    """
    order = ["row_id"] if "row_id" in df.columns else schemas.GAZETTEER_COLUMNS
    df.orderBy(*order).select(*schemas.GAZETTEER_COLUMNS).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
