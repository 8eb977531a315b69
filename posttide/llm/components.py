"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.session import materialize

MAX_ROUNDS = 60


def _signature(links: DataFrame) -> tuple:
    """Tells two sets of links apart: their number and two independent hashes, which no number of links overflows."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                           F.bit_xor(F.xxhash64(F.lit("second"), "b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that has a link to another node; root is the smallest node of its component.

    `links` has two integer columns of one type, in any order and with repeats; links of a node to itself or to
    null are ignored. Nodes are tied to the smallest neighbour known, first all larger neighbours of a node, then
    all smaller ones, until nothing changes. A round is two aggregations and joins by node; a node with very many
    neighbours only makes one side of a join uneven, which adaptive execution splits. Each round is written to the
    shared folder, so lost executors repeat one round at most.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs = materialize(pairs, "links")
    before = _signature(pairs)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        larger = (both.where("b > a").join(smallest, "a")
                  .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = (larger.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        pairs = materialize(smaller, "links")
        after = _signature(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
