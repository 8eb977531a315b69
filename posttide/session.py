"""Session set-up and the shared scratch area used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Scratch paths of the jobs now running, innermost last.
_held: list[list[str]] = []


def build_session(app: str = "posttide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew splitting switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Only a session of one process may fall back to a folder of its own: on a
    cluster, local-cluster included, it would be invisible to other executors.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="posttide-")
    spark.conf.set(CHECKPOINT_KEY, fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/posttide/{label}-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(path)
    return path


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is written to the shared folder within, when the job is through or has failed.

    Tables that read from there end with it, so a job writes its results inside.
    """
    paths: list[str] = []
    _held.append(paths)
    try:
        yield
    finally:
        _held.remove(paths)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            found = hadoop(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    used, and carries file sizes that Catalyst can plan with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
