"""Tables that jobs append to safely: a job run again adds nothing, writers may work at the same time, and a job that
dies leaves nothing to see.

A batch is written to a folder of its own, with ids from 1 per month. It becomes part of the table by one rename of a
small commit file to the next free number. The commit names the batch's folder, its job, the ids that each month had
before it, and the last ids of all months: the ledger. Whoever finds the number taken reads the ledger again and takes
the next one; the batch stays as it was written, since readers add the month's earlier ids. Stored posts are never
scanned for ids.

The rename must fail where its target exists, as one step: HDFS does that. A local file system looks before it renames.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide import schemas
from posttide.operators.joins import lookup_join
from posttide.operators.ranking import assign_ids
from posttide.session import materialize
from posttide.sources.writers import ROWS_PER_FILE

MONTH = "year_month"
#: Attempts at the next free number before a writer gives up.
TRIES = 1000


class Conflict(RuntimeError):
    """Other writers took every number that was tried."""


@dataclass
class Commit:
    """One batch of a table, and the ledger after it."""

    number: int
    job: str
    batch: str
    before: dict[str, int]  # ids that the batch's months had before it
    last: dict[str, int]  # last id of every month of the table, the batch included
    columns: str  # the batch's schema


class _Files:
    """The log folder of a table, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.root = f"{table.rstrip('/')}/log"
        self.system = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.system.getUri(), spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        root = self.path(self.root)
        if not self.system.exists(root):
            return []
        found = [status.getPath().getName() for status in self.system.listStatus(root)]
        return sorted(n for n in found if n.endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.system.open(self.path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def claim(self, name: str, content: dict) -> bool:
        """Write the file whole under another name, then rename it; False where the name is taken."""
        draft = self.path(f"{self.root}/{uuid.uuid4().hex}.draft")
        stream = self.system.create(draft)
        stream.write(json.dumps(content).encode("utf-8"))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.gateway.new_array(options, 1)
        no_overwrite[0] = options.NONE
        try:
            self.context.rename(draft, self.path(f"{self.root}/{name}"), no_overwrite)
            return True
        except Py4JJavaError as error:
            self.system.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise


def _name(number: int) -> str:
    return f"{number:012d}.json"


def commits(spark: SparkSession, table: str) -> list[Commit]:
    """The batches of a table, first to last: one small file each."""
    files = _Files(spark, table)
    return [Commit(**files.read(name)) for name in files.names()]


def has_commits(spark: SparkSession, table: str) -> bool:
    return bool(_Files(spark, table).names())


def stage(df: DataFrame, table: str) -> tuple[str, dict[str, int], str]:
    """Write a batch numbered from 1 per month, unseen by readers: its folder, its months' sizes, its schema.

    Needs `year_month`, `file`, `pos`; rows without a month are an error, since no folder could hold their ids.
    """
    numbered = assign_ids(df)
    carried = [c for c in schemas.PREPROCESSED_COLUMNS if c in numbered.columns]
    rows = numbered.select(*carried, MONTH)
    batch = f"batch-{uuid.uuid4().hex}"
    folder = f"{table.rstrip('/')}/data/batch={batch}"
    rows.write.partitionBy(MONTH).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(folder)
    stored = df.sparkSession.read.schema(rows.schema).parquet(folder)
    sizes = {r[0]: r[1] for r in stored.groupBy(MONTH).agg(F.max("id")).collect()}  # a row per month
    if None in sizes:
        raise ValueError("rows without a month cannot be numbered")
    return batch, sizes, T.StructType([f for f in rows.schema if f.name != MONTH]).json()


def commit(spark: SparkSession, table: str, job: str, batch: str, sizes: dict[str, int], columns: str) -> bool:
    """Make a staged batch part of the table; False if the job is already there, which leaves the batch unseen."""
    files = _Files(spark, table)
    for _ in range(TRIES):
        known = commits(spark, table)
        if any(c.job == job for c in known):
            return False
        if known and known[0].columns != columns:
            raise ValueError(f"the table under {table} has other columns")
        last = dict(known[-1].last) if known else {}
        before = {month: last.get(month, 0) for month in sizes}
        last.update({month: before[month] + n for month, n in sizes.items()})
        number = known[-1].number + 1 if known else 1
        content = Commit(number, job, batch, before, last, columns)
        if files.claim(_name(number), vars(content)):
            return True
    raise Conflict(f"no number for job {job!r} in {TRIES} attempts")


def append_once(df: DataFrame, table: str, job: str) -> bool:
    """Append preprocessed posts, numbered per month, as job `job`; False if that job has already been appended.

    `job` names the work, not the attempt: give a run that is repeated the same name. What an attempt that died has
    written stays in its folder, unseen.
    """
    spark = df.sparkSession
    if any(c.job == job for c in commits(spark, table)):
        return False
    return commit(spark, table, job, *stage(df, table))


def read_appended(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the committed batches, `id` running per month in the order of the commits.

    A filter on `year_month` reads the folders of those months only.
    """
    known = commits(spark, table)
    if not known:
        raise ValueError(f"nothing has been appended under {table}")
    root = f"{table.rstrip('/')}/data"
    fields = T.StructType.fromJson(json.loads(known[0].columns))
    schema = T.StructType([*fields, T.StructField("batch", T.StringType()), T.StructField(MONTH, T.StringType())])
    folders = [f"{root}/batch={c.batch}" for c in known if c.before]
    if not folders:
        return spark.createDataFrame([], T.StructType([*fields, T.StructField(MONTH, T.StringType())]))
    stored = spark.read.schema(schema).option("basePath", root).parquet(*folders)
    earlier = spark.createDataFrame([(c.batch, month, n) for c in known for month, n in c.before.items()],
                                    "batch string, year_month string, _before bigint")
    placed = lookup_join(stored, materialize(earlier, "ledger"), ["batch", MONTH], "inner")
    return placed.withColumn("id", F.col("id") + F.col("_before")).select(*fields.names, MONTH)
