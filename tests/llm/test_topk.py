import math
import random

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from posttide.llm import queries, topk


def plain(rows, k, every):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), c is None, c or 0, m) for m, (c, b) in enumerate(whole)
                  if m != n and len(a) == len(b)]
        out += [(q, r, None if missing else c, -s) for r, (s, missing, c, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(topk, "SMALLEST", 16)
    rng = random.Random(width)
    rows = [(i, [float(np.float32(rng.choice([rng.uniform(-1, 1), 0.25, -0.5]))) for _ in range(width)]) for i in range(150)]
    rows += [(200, None), (201, [None] * width), (205, [float("nan")] * width), (210, [float("inf")] * width),
             (215, []), (None, rows[3][1]), (0, rows[0][1]), (5, rows[5][1]), (220, [0.5] * (width + 1))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(table, k=5, every=5)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 5, 5)


def test_few_rows_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    table = table.withColumns({c: F.lit(1) for c in ("row", "a", "b", "score")})
    assert [tuple(r) for r in topk.top_k(table).collect()] == [(0, 1, 1, 256 * 768 + 512 * 1024)]
    assert topk.top_k(table.where("vec_id > 5")).count() == 0
    assert topk.top_k(table.where("vec_id = 0")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-256, 256, (40, 50)), rng.integers(-256, 256, (60, 50))
    for segments in (1, 4, 16, 50, 99):
        bound = topk.segment_statistics(a, segments) @ topk.segment_statistics(b, segments).T
        assert (bound >= a @ b.T - 1e-6).all()


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, queries.op7_exact_top_k, queries.ORACLE["op7_exact_top_k"]) is None
