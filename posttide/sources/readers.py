"""Readers: CSV by header name, and the tables the jobs hand to each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide import schemas
from posttide.functions import dates
from posttide.operators.joins import lookup_join
from posttide.operators.ranking import BLOCK_ROWS, bucketed_row_number
from posttide.session import materialize
from posttide.sources import ledger

# Columns read at first; files with more are read again with as many as the widest header has.
COLUMNS = 64


def _scan(spark: SparkSession, path: str | Sequence[str], width: int, multiline: bool, recursive: bool,
          glob: str) -> DataFrame:
    """Every record of every file by place: `cells`, `file`, `pos`, and `record`, its text if it has not `width` cells."""
    cells = [f"c{i}" for i in range(width)]
    found = (spark.read.schema(", ".join(f"{c} string" for c in [*cells, "record"]))
             .option("header", False).option("multiLine", multiline).option("escape", '"')
             .option("columnNameOfCorruptRecord", "record").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).csv(path))
    return found.select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file"),
                        F.monotonically_increasing_id().alias("pos"),
                        F.coalesce(F.length("record") - F.length(F.replace("record", F.lit(","))) + 1,
                                   F.lit(width)).alias("most"))


def read_csv_by_header(spark: SparkSession, path: str | Sequence[str],
                       columns: Mapping[str, str] | Sequence[str], multiline: bool = True,
                       recursive: bool = False, glob: str = "*.csv", only_present: bool = False) -> DataFrame:
    """All CSV files under `path`, columns picked by header name.

    Spark matches CSV columns by position, so files with another column order
    would shift values silently. All records are landed once, by position; the
    header of a file is its first record, and rows find their columns by the
    places that the header of their file gives. Any number of headers costs one
    scan and a join with a table of one row per file. A column that a file lacks
    is NULL, and with `only_present` one that all files lack is left out; of a
    repeated name the first counts; empty files have no rows.
    Values are text, or cast with `try_cast` to the given types.

    Adds `file` (its path) and `pos` (place in scan order, growing within a file;
    splits of one file are of equal size but the last, and keep their order), and keeps
    line breaks inside quotes when `multiline` is set; such files do not split.
    """
    types = columns if isinstance(columns, Mapping) else dict.fromkeys(columns, "string")
    width = COLUMNS
    while True:
        landed = materialize(_scan(spark, path, width, multiline, recursive, glob), "landed-csv")
        first = materialize(landed.groupBy("file").agg(F.min("pos").alias("first")), "first-records")
        heads = materialize(lookup_join(landed, first, ["file"], "inner").where(F.col("pos") == F.col("first"))
                            .select("file", "first", F.col("cells").alias("header"), "most"), "csv-headers")
        widest = heads.agg(F.max("most")).first()[0]
        if widest is None:
            raise FileNotFoundError(f"no rows in files that match {glob} under {path}")
        if widest <= width:
            break
        width = widest
    header = F.transform("header", lambda h, i: F.when(i == 0, F.ltrim(h, F.lit("\ufeff"))).otherwise(h))
    places = F.array(*[F.array_position("header", F.lit(c)).cast("int") for c in types])
    heads = materialize(heads.withColumn("header", header).select("file", "first", places.alias("places")), "csv-places")
    if only_present:
        seen = heads.agg(*[F.max(F.col("places")[i]).alias(c) for i, c in enumerate(types)]).first()
        shown = [c for c in types if seen[c]]
    else:
        shown = list(types)
    rows = lookup_join(landed.drop("most"), heads, ["file"], "inner").where(F.col("pos") > F.col("first"))

    def value(i: int, kind: str) -> Column:
        place = F.col("places")[i]
        return F.when(place > 0, F.get("cells", place - 1)).try_cast(kind)

    return rows.select(*[value(i, kind).alias(c) for i, (c, kind) in enumerate(types.items()) if c in shown],
                       "file", "pos")


def read_posts(spark: SparkSession, path: str, multiline: bool = True, recursive: bool = False,
               glob: str = "*.csv") -> DataFrame:
    """Raw posts of a directory as text columns, with `file` and `pos`."""
    return read_csv_by_header(spark, path, schemas.RAW_POST_COLUMNS, multiline, recursive, glob)


def land_posts(posts: DataFrame, path: str | None = None) -> DataFrame:
    """Write raw posts as Parquet once, so that later scans split, prune and keep row places."""
    if path is None:
        return materialize(posts, "landed-posts")
    posts.write.mode("overwrite").parquet(path)
    return posts.sparkSession.read.schema(posts.schema).parquet(path)


def assign_file_month(df: DataFrame, created: Column | None = None, file: str = "file",
                      position: str = "pos") -> DataFrame:
    """Add `year_month` of a file: the month of its first row whose timestamp can be read.

    Rows of files without such a row are dropped. One aggregation by file that
    combines before the shuffle; the rows only meet the small file table.
    """
    month = dates.post_month(F.col("tweetcreatedts") if created is None else created)
    place = F.when(month.isNotNull(), F.col(position))
    months = (df.groupBy(file).agg(F.min_by(month, place).alias("year_month"))
              .where(F.col("year_month").isNotNull()))
    return lookup_join(df, materialize(months, "file-months"), [file], "inner")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Typed gazetteer with `row_id` from 1, by file name and then place in the file."""
    gaz = read_csv_by_header(spark, path, schemas.GAZETTEER_TYPES, glob="*")
    blocked = gaz.withColumn("_block", F.floor(F.col("pos") / F.lit(BLOCK_ROWS)))
    numbered = bucketed_row_number(blocked, [], ["file", "_block"], [F.col("pos")], "row_id")
    return numbered.select(*schemas.GAZETTEER_COLUMNS, "row_id")


def _stored_csv(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """CSV folders as our writers leave them: lists as JSON, `year_month` in the path of a file."""
    lists = {c: t for c, t in types.items() if t.startswith("array")}
    found = read_csv_by_header(spark, path, {c: "string" if c in lists else t for c, t in types.items()}, recursive=True)
    named = F.regexp_extract("file", r"year_month=(\d{4}_\d{2})/", 1)
    month = F.when(named != "", named).otherwise(F.nullif(month_from_file_name(F.col("file")), F.lit("")))
    parsed = {c: F.from_json(c, t) for c, t in lists.items()}
    return found.withColumns({**parsed, "year_month": month}).drop("file", "pos")


def read_preprocessed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Preprocessed posts written by `write_posts` or `ledger.append_once`; on Parquet, filters on `year_month` prune
    folders."""
    if fmt == "csv":
        return _stored_csv(spark, path, {c: t for c, t in schemas.LABELLED_TYPES.items()
                                         if c in schemas.PREPROCESSED_COLUMNS})
    if ledger.has_commits(spark, path):
        return ledger.read_appended(spark, path)
    return spark.read.parquet(path)


def read_month(spark: SparkSession, path: str, month: str, fmt: str = "parquet") -> DataFrame:
    """One month of preprocessed posts: only its folder is read."""
    if fmt == "csv":
        return read_preprocessed(spark, f"{path}/year_month={month}", fmt)
    return read_preprocessed(spark, path).where(F.col("year_month") == month)


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All labelled posts of a folder, stacked by column name; missing columns are NULL.

    The types are given, so no Parquet file has to be opened to find them. The
    month of a CSV file is that of its folder, else of its name.
    """
    if fmt == "csv":
        return _stored_csv(spark, path, schemas.LABELLED_TYPES)
    columns = ", ".join(f"{c} {t}" for c, t in {**schemas.LABELLED_TYPES, "year_month": "string"}.items())
    return spark.read.schema(columns).parquet(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Labelled training texts (textID, text, selected_text, sentiment)."""
    return read_csv_by_header(spark, path, schemas.TRAINING_COLUMNS, glob="*").select(
        *schemas.TRAINING_COLUMNS)


def row_file_counts(df: DataFrame, file: str = "file") -> DataFrame:
    """(n_rows, n_files): files are counted on the table of rows per file."""
    per_file = df.groupBy(file).agg(F.count("*").alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                        F.count(file).alias("n_files"))


def month_from_file_name(c: Column) -> Column:
    """The seven characters before the extension of a file name, such as `2022_03`."""
    return F.regexp_extract(c, r"(.{7})\.[^.]*$", 1)
