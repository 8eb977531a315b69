import hashlib
import math
import random

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from posttide.llm import centroids, queries


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]

    def name(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centers = [list(v) for _, v in sorted(kept, key=name)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for d, c in found if c == n) for n in range(len(centers))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia), told[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def rows_of(width, n, seed):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(5)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, rng.choice([0.01, 0.3])))) for m in rng.choice(middles)])
            for i in range(n)]
    rows += [(n + 1, None), (n + 2, [None] * width), (n + 3, [float("nan")] * width), (n + 4, [math.inf] * width),
             (n + 5, [0.5] * (width + 1)), (n + 6, []), (None, rows[0][1]), (None, rows[1][1])]
    return rows + rows[:7] + [(500 + i, rows[3][1]) for i in range(60)]


@pytest.mark.parametrize("width,head", [(64, 12), (64, 64), (3, 1)])
def test_equals_brute_force(spark, width, head):
    rows = rows_of(width, 120, width)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    table = table.withColumns({c: F.lit(1) for c in ("v", "head", "rest", "cluster", "distance")})
    got = centroids.cluster(table, k=6, rounds=3, width=width, head=head)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 6, 3, width)


def test_few_rows_and_no_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, [-3.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(table, width=2, head=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 16, 3, 2)
    empty = centroids.cluster(table.where("vec_id > 5"), width=2, head=2)
    assert empty.count() == 0 and empty.columns == got.columns
    assert centroids.cluster(table).count() == 0  # no vector of 64 components


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(i, [0.0, 1.0]) for i in range(5, 10)] + [(10, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(table, k=11, rounds=2, width=2, head=1)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 11, 2, 2)


def test_components_beyond_the_bound_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or larger once scaled"):
        centroids.cluster(table, width=2, head=1).collect()


def test_the_filter_spares_distances():
    rng = np.random.default_rng(3)
    middles = rng.integers(-200, 200, (16, 64))
    x = middles[rng.integers(0, 16, 2000)] + rng.integers(-10, 10, (2000, 64))
    _, directions = np.linalg.eigh(np.cov(x.T))
    directions, mean = directions[:, ::-1][:, :12], x.mean(axis=0)
    found, distance, tried = centroids.nearest(x, *centroids.split(x.astype(float), mean, directions), middles,
                                               *centroids.split(middles.astype(float), mean, directions))
    whole = ((x[:, None] - middles) ** 2).sum(axis=2)
    assert (found == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert tried < 2 * len(x)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, queries.op12_centroid_clusters, queries.ORACLE["op12_centroid_clusters"]) is None
