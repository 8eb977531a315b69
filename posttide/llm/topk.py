"""Exact top-k search: bounds from segment means and deviations, coarse to fine, then exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posttide.session import materialize

SCALE = 256
#: Segments of a vector at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Vectors of one group of candidates and of one group of queries; groups of a small table are smaller, so that
#: all tasks have some.
CANDIDATES = 1 << 17
QUERIES = 1 << 14
SMALLEST = 1 << 11
TRIED = 32


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their length. By Cauchy-Schwarz the product of
    two rows is at least the inner product of the vectors: so it bounds their distance from below."""
    width = vectors.shape[1]
    cuts = np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = vectors[:, a:b].astype(float)
        parts += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(parts, axis=1) if parts else np.zeros((len(vectors), 1))


def best_in_group(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray,
                  order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best candidates of each query; a query's own row is left out. `order`
    ranks the candidates for ties.

    A few candidates with the best coarse bounds give a score to beat. Whoever can't beat or equal it by the
    coarse bound drops out, then by the finer bound; survivors are scored exactly, in whole numbers.
    """
    levels = [(segment_statistics(queries, s), segment_statistics(vectors, s)) for s in RESOLUTIONS]
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    out_q, out_c, out_s = [], [], []
    for start in range(0, len(queries), 256):
        coarse = levels[0][0][start:start + 256] @ levels[0][1].T
        for i, bound in enumerate(coarse, start):
            query = queries[i]
            slack = 1e-9 * float(np.sqrt((query.astype(float) ** 2).sum())) * length + 1e-6
            own = rows == query_rows[i]
            bound = np.where(own, -np.inf, bound + slack)
            n = min(len(rows), TRIED + k)
            first = np.argpartition(-bound, n - 1)[:n]
            first = first[~own[first]]
            tried = vectors[first] @ query
            beat = np.partition(tried, len(tried) - k)[len(tried) - k] if len(tried) >= k else -np.inf
            left = np.flatnonzero(bound >= beat)
            for theirs, ours in levels[1:]:
                left = left[ours[left] @ theirs[i] + slack[left] >= beat]
            left = left[~own[left]]
            score = vectors[left] @ query
            top = np.lexsort((order[left], -score))[:k]
            out_q.append(np.full(len(top), i))
            out_c.append(left[top])
            out_s.append(score[top])
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, the k rows with the highest inner product of the components
    floor(256 * x): query_id, rank (from 1), vec_id, score; all other rows, if fewer. Ties go to the smaller id,
    null ids last.

    Vectors that are null or hold null or non-finite components take no part, and only vectors of one length are
    compared. A row never finds itself, but finds equal rows. Scores are 64-bit whole numbers. Queries and
    candidates are dealt in groups; each pair of groups meets in one task and sends on k rows a query.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    table = materialize(vectors.where(usable(F.col(embedding))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"),
        F.size(embedding).alias("width"), whole.alias("v")), "vectors")
    asked = (F.col("id") % every == 0)
    n, q = table.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // CANDIDATES), min(parts, -(-n // SMALLEST)))
    sides = max(1, -(-q // QUERIES))

    def dealt(into: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(into)).cast("int")

    def all_of(into: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(into - 1)))

    candidates = table.select("*", dealt(groups, 1).alias("a"), all_of(sides).alias("b"))
    # Names of their own: both sides read one table, and columns of one name would be taken for one another.
    queries = table.where(asked).select(F.col("row").alias("query"), F.col("id").alias("query_id"),
                                        F.col("width").alias("query_width"), F.col("v").alias("query_v"),
                                        all_of(groups).alias("query_a"), dealt(sides, 2).alias("query_b"))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(table: pa.Table, name: str) -> np.ndarray:
            flat = table.column(name).combine_chunks().flatten().to_numpy()
            return flat.reshape(table.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64),) * 3
        else:
            rows = left.column("row").to_numpy()
            ids = np.array([(x is None, x or 0) for x in left.column("id").to_pylist()])
            order = np.empty(len(rows), np.int64)
            order[np.lexsort((rows, ids[:, 1], ids[:, 0]))] = np.arange(len(rows))
            found = best_in_group(matrix(right, "query_v"), right.column("query").to_numpy(), matrix(left, "v"), rows,
                                  order, k)
        q, c, score = (pa.array(x, pa.int64()) for x in found)
        return pa.table({"query": right.column("query").take(q), "query_id": right.column("query_id").take(q),
                         "row": left.column("row").take(c), "vec_id": left.column("id").take(c), "score": score})

    found = candidates.groupBy("a", "b", "width").cogroup(
        queries.groupBy("query_a", "query_b", "query_width")).applyInArrow(
        searched, "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
