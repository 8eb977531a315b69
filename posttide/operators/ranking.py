"""Exact row numbers without one task holding a whole group.

A window over a hot group would sort it in one task. Here a group is cut into
ordered buckets: bucket sizes are counted first (a small table), their running
sum gives every bucket its offset, and only rows of one bucket are sorted
together. Offset plus place in the bucket is the row number a single window
over the group would give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttide.operators.joins import lookup_join
from posttide.session import materialize

BLOCK_ROWS = 1 << 20


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the group as one struct column: structs compare NULL fields as equal."""
    return (df.withColumn("_group", F.struct(*by)), ["_group"]) if by else (df, [])


def _offsets(df: DataFrame, group: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Rows of the group in earlier buckets, and in all of its buckets."""
    sizes = df.groupBy(*group, *buckets).agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, *buckets,
                        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
                        F.sum("_size").over(whole).alias("_total"))


def bucketed_row_number(df: DataFrame, by: Sequence[str], buckets: Sequence[str],
                        order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """`row_number` over `by` ordered by (`buckets`, `order`) as column `name`.

    `buckets` must not be NULL. `total` names a column for the size of the group.
    The offsets, one row per bucket, are written and measured; they are normally
    broadcast, so rows are shuffled once, for the window.
    """
    grouped, group = _grouped(df, by)
    offsets = materialize(_offsets(grouped, group, buckets), "offsets")
    placed = grouped.withColumn(
        "_place", F.row_number().over(Window.partitionBy(*by, *buckets).orderBy(*order)))
    joined = lookup_join(placed, offsets, [*group, *buckets])
    extra = [F.col("_total").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name), *extra)


def assign_ids(df: DataFrame, by: str = "year_month", file: str = "file", position: str = "pos",
               start: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running id per `by` from 1, in file order and then row order.

    `position` is the place of the row in its file. Files are cut into blocks
    of `block_rows` positions, so a file of any size spreads over many tasks.
    `start` (`by`, `last_id`) holds the ids already given out by earlier runs.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block_rows)))
    out = bucketed_row_number(blocked, [by], [file, "_block"], [F.col(position)], "id").drop("_block")
    if start is None:
        return out
    out = lookup_join(out, start.select(by, "last_id"), [by])
    return (out.withColumn("id", F.col("id") + F.coalesce(F.col("last_id"), F.lit(0)))
            .drop("last_id"))


def shuffle_key(ids: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random text per row: MD5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
                 .cast("binary"))


def _hash_bucket(key: str) -> Column:
    """First four hex digits: 65,536 buckets, in the order of the whole key."""
    return F.substring(key, 1, 4)


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, ids: Sequence[str] = ("id",),
                 name: str = "fold") -> DataFrame:
    """Shuffle rows into folds 1..k; the first `n mod k` folds hold one row more."""
    keyed = df.withColumn("_key", shuffle_key(ids, seed)).withColumn("_bucket", _hash_bucket("_key"))
    ranked = bucketed_row_number(
        keyed, [], ["_bucket"], [F.col("_key"), *[F.col(c) for c in ids]], "_rank", "_rows")
    low, longer = F.expr(f"_rows div {k}"), F.expr(f"_rows % {k}")
    place, long_rows = F.col("_rank") - 1, longer * (low + 1)
    fold = F.when(place < long_rows, F.floor(F.try_divide(place, low + 1))).otherwise(
        longer + F.floor(F.try_divide(place - long_rows, low)))
    return ranked.select(*df.columns, (fold + 1).cast("int").alias(name))


def sample_exact(df: DataFrame, n: int = 500_000, by: Sequence[str] = ("year_month",),
                 ids: Sequence[str] = ("id",), seed: int = 0) -> DataFrame:
    """Exactly `n` rows per group, or the whole group if it is not larger.

    Rows with the smallest shuffle keys are kept. Bucket counts tell in which
    bucket of the key a group reaches `n`: rows of earlier buckets stay as they
    are, later ones go, and only the rows of that one bucket are shuffled and ranked.
    """
    keyed = df.withColumn("_key", shuffle_key(ids, seed)).withColumn("_bucket", _hash_bucket("_key"))
    keyed, group = _grouped(keyed, by)
    cuts = materialize(
        _offsets(keyed, group, ["_bucket"])
        .where(F.col("_before") < n)
        .groupBy(*group)
        .agg(F.max("_bucket").alias("_cut"), F.max("_before").alias("_whole")),
        "sample-cuts")
    joined = lookup_join(keyed, cuts, group, "inner")
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy("_key", *ids)
    ranked = (joined.where(F.col("_bucket") == F.col("_cut")).withColumn("_place", F.row_number().over(in_bucket))
              .where(F.col("_place") <= F.lit(n) - F.col("_whole")))
    whole = joined.where(F.col("_bucket") < F.col("_cut"))
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))
