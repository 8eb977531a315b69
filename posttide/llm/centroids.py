"""Centroid clustering in whole numbers, with a filter on rotated coordinates.

The rotation is that of the principal components. Of every vector its leading coordinates and the length of the rest
are stored. For a vector x and a centroid c, with heads p and q and rests r and s,

    |x - c|^2  >=  |p - q|^2 + (r - s)^2

so a centroid whose bound exceeds an exact distance already known cannot be nearer. What is left is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.llm.topk import usable
from posttide.session import materialize

SCALE = 64
WIDTH = 64
#: Leading rotated coordinates that are stored.
HEAD = 12
#: Components at and beyond this size would let a squared distance pass 64 bits.
LARGEST = 1 << 27
#: Vectors compared at once.
ROWS = 1 << 14


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rotation(table: DataFrame, width: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of the column v. Sums of the vectors and of their products are added
    up per task, then by Spark; a row per component is all that comes to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            total[:width] += x.T @ x
            total[width] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(width + 1), width)), pa.array(np.tile(np.arange(width), width + 1)),
             pa.array(total.ravel())], ["i", "j", "s"])

    cells = table.select("v").mapInArrow(summed, "i bigint, j bigint, s double")
    sums = np.zeros((width + 1, width))
    for i, j, s in cells.groupBy("i", "j").agg(F.sum("s")).collect():
        sums[i, j] = s
    n = max(1, table.count())
    mean = sums[width] / n
    _, directions = np.linalg.eigh(sums[:width] / n - np.outer(mean, mean))
    return mean, directions[:, ::-1][:, :head]


def split(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of vectors (rows) and the length of what these leave over."""
    x = x - mean
    head = x @ directions
    return head, np.linalg.norm(x - head @ directions.T, axis=1)


def nearest(x: np.ndarray, head: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_head: np.ndarray,
            c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of whole-number vectors, the smaller number at ties, and how many exact distances
    that took. Bounds are lowered by more than their rounding can be."""
    bound = ((head ** 2).sum(axis=1)[:, None] + (c_head ** 2).sum(axis=1) - 2 * head @ c_head.T
             + (rest[:, None] - c_rest) ** 2)
    size = (head ** 2).sum(axis=1) + rest ** 2
    bound -= 1e-9 * (size[:, None] + (c_head ** 2).sum(axis=1) + c_rest ** 2) + 1e-6

    def exact(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x[rows] - centroids[c]
        return (d * d).sum(axis=1)

    everyone = np.arange(len(x))
    best = bound.argmin(axis=1)
    distance = exact(everyone, best)
    rows, others = np.nonzero(bound <= distance[:, None])
    left = others != best[rows]
    rows, others = rows[left], others[left]
    found = exact(rows, others)
    # By row, then distance, then number of the centroid: the first of each row is its best other one.
    order = np.lexsort((others, found, rows))
    rows, others, found = rows[order], others[order], found[order]
    first = np.concatenate(([True], rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
    rows, others, found = rows[first], others[first], found[first]
    better = (found < distance[rows]) | ((found == distance[rows]) & (others < best[rows]))
    best[rows[better]], distance[rows[better]] = others[better], found[better]
    return best, distance, len(x) + len(order)


def chunks(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    """Slices of batches, their vectors and what `nearest` finds for them."""
    centroids, mean, directions = model.value
    c_head, c_rest = split(centroids.astype(float), mean, directions)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = matrix(part.column("v"), centroids.shape[1])
            head = matrix(part.column("head"), directions.shape[1])
            yield part, x, nearest(x, head, part.column("rest").to_numpy(), centroids, c_head, c_rest)


def sums_by_cluster(table: DataFrame, model: Broadcast, k: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the vectors nearest to each centroid; empty clusters are missing."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, x, (cluster, _, _) in chunks(batches, model):
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), width + 1)), pa.array(np.tile(np.arange(width + 1), k)),
             pa.array(np.concatenate((total, count[:, None]), axis=1).ravel())], ["cluster", "i", "s"])

    cells = table.select("v", "head", "rest").mapInArrow(added, "cluster bigint, i bigint, s bigint")
    found = {c: [0] * (width + 1) for c in range(k)}
    for c, i, s in cells.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        found[c][i] = int(s)
    return {c: (row[width], row[:width]) for c, row in found.items() if row[width]}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = WIDTH, scale: int = SCALE,
            head: int = HEAD, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each vector vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors of exactly `width` components, none null or non-finite, take part, each component x as floor(scale * x).
    The first centroids are the `k` vectors with the smallest lowercase-hex SHA-256 of `seed:vec_id` (equal hashes,
    so repeated ids, by the vector itself; null ids last), all if there are fewer. Each round assigns every vector
    to the nearest centroid, ties to the smaller number, and replaces every non-empty centroid by floor(sum / count).
    Then vectors are assigned once more. All of it is exact; components of 2^27 and more are refused, since their
    distances pass 64 bits. Repeated rows stay repeated rows, other columns are left out, and an empty table gives
    an empty result. The driver holds `k` centroids and sums of k * width cells, whatever the input.
    """
    if not 0 < head <= width:
        raise ValueError("the head has between one and all coordinates")
    spark = vectors.sparkSession
    scaled = F.transform(F.col(f"`{embedding}`"), lambda x: F.floor(x.cast("double") * scale))
    whole = vectors.where(usable(F.col(f"`{embedding}`")) & (F.size(F.col(f"`{embedding}`")) == width)).select(
        F.col(f"`{vec_id}`").alias("vec_id"), scaled.alias("v"))
    large = F.exists("v", lambda x: F.abs(x.cast("double")) >= float(LARGEST))
    refused = F.raise_error(F.lit(f"a component of a vector is {LARGEST} or larger once scaled"))
    whole = materialize(whole.select("vec_id", F.when(large, refused.cast("array<bigint>")).otherwise(
        F.col("v").cast("array<bigint>")).alias("v")), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {dict(whole.dtypes)['vec_id']}, cluster int, distance bigint, "
                                         "cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    mean, directions = rotation(whole, width, head)

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                heads, rest = split(matrix(part.column("v"), width).astype(float), mean, directions)
                flat = pa.ListArray.from_arrays(np.arange(0, heads.size + 1, heads.shape[1], dtype=np.int32),
                                                pa.array(heads.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), flat, pa.array(rest)],
                                                 ["vec_id", "v", "head", "rest"])

    kind = dict(whole.dtypes)["vec_id"]
    table = materialize(whole.mapInArrow(rotated, f"vec_id {kind}, v array<bigint>, head array<double>, rest double"),
                        "rotated")
    context = spark.sparkContext
    for _ in range(rounds):
        model = context.broadcast((centroids, mean, directions))
        for c, (n, total) in sums_by_cluster(table, model, k, width).items():
            centroids[c] = [s // n for s in total]
    model = context.broadcast((centroids, mean, directions))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (found, distance, _) in chunks(batches, model):
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "cluster", "distance"])

    found = materialize(table.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {c: int(s) for c, s in found.groupBy("cluster").agg(wide).collect()}
    told = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in inertia.items()]
    # One row per centroid.
    each = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
