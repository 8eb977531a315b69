"""Looking rows up in a smaller table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 128 * 1024 * 1024
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows written as JSON, an upper estimate of what a broadcast ships."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(32))).first()[0]
    return int(size or 0)


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                max_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join `df` to `lookup`, a table with one or few rows per `on` key.

    `lookup` should be a written table (see `session.materialize`): it is
    measured first. Up to `max_bytes` it is broadcast and `df` is not shuffled.
    Beyond, both sides are shuffled on key and salt: every lookup row is
    repeated once per salt, so rows of one hot key spread over `salts` tasks,
    and adaptive execution splits what is still too large. The salt is a hash of
    the whole row, so a task that runs again places its rows the same way.
    Spark is told to sort and merge: it plans with the size of the lookup's
    compressed files, without its repetition, and might broadcast that.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    if measured_bytes(lookup) <= max_bytes:
        return df.join(F.broadcast(lookup), on, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    repeated = lookup.withColumn("_salt", every_salt)
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
