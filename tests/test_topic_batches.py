import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posttide.operators import terms, topic_batches as tb
from posttide.plans import queries


def psi(x):
    """Digamma by twenty steps up and two terms of the series."""
    low = sum(1 / (x + i) for i in range(20))
    x += 20
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - low


def logs(row):
    return [math.exp(psi(v) - psi(sum(row))) for v in row]


def plain_fit(docs, n_terms, k, seed, passes, batch):
    """docs: key -> {term: count}. One document after the other, floats, no Spark."""
    order = sorted(docs, key=lambda key: hashlib.md5(f"{seed}:{key}".encode()).hexdigest())
    weights = np.random.RandomState(seed).gamma(100.0, 0.01, (k, n_terms))
    step = 0
    for _ in range(passes):
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            beta = np.array([logs(row) for row in weights.tolist()])
            gained = np.zeros((k, n_terms))
            for key in part:
                gamma = [1.0] * k
                theta = logs(gamma)
                for _ in range(100):
                    old = gamma
                    norm = {w: sum(theta[t] * beta[t, w] for t in range(k)) for w in docs[key]}
                    gamma = [1 / k + theta[t] * sum(n * beta[t, w] / norm[w] for w, n in docs[key].items())
                             for t in range(k)]
                    theta = logs(gamma)
                    if sum(abs(a - b) for a, b in zip(gamma, old)) / k < 1e-3:
                        break
                for w, n in docs[key].items():
                    norm = sum(theta[t] * beta[t, w] for t in range(k))
                    for t in range(k):
                        gained[t, w] += theta[t] * beta[t, w] * n / norm
            step += 1
            share = (10 + step) ** -0.7
            weights = (1 - share) * weights + share * (1 / k + len(order) / len(part) * gained)
    return weights


def counted(bags):
    return {r[0]: dict(zip(r["features"].indices.tolist(), r["features"].values.tolist())) for r in bags.collect()}


def test_digamma():
    x = np.array([0.01, 0.1, 1.0, 2.5, 40.0])
    assert np.allclose(tb.digamma(x), [psi(v) for v in x.tolist()], rtol=1e-11, atol=1e-11)
    assert abs(tb.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


def test_fit_on_the_table_equals_a_plain_fit(spark, sf_dir):
    bags, _, words = queries.bags(spark, sf_dir)
    bags = bags.select("row_key", "features")
    wanted = plain_fit(counted(bags), len(words), 4, 20, 2, 128)
    found = tb.fit_topics_in_batches(bags, "row_key", len(words), k=4, passes=2)
    assert np.allclose(found.weights, wanted, rtol=1e-6, atol=1e-6)


def toy(spark, n=70):
    rng = random.Random(3)
    sides = ["sea sun sand wave beach".split(), "code bug test merge branch".split()]
    rows = [(i, [rng.choice(sides[i % 2]) for _ in range(8)] if i % 10 else []) for i in range(n)]
    words = sorted(sum(sides, []))
    return terms.bag_of_words(spark.createDataFrame(rows, "id long, tokens array<string>"), words), words


def test_partitions_do_not_matter(spark):
    bags, words = toy(spark)
    models = [tb.fit_topics_in_batches(bags.repartition(n), "id", len(words), k=2, passes=3, batch=16).weights
              for n in (1, 8)]
    assert (models[0] == models[1]).all()


def test_topics_are_found_and_shares_sum_to_one(spark):
    bags, words = toy(spark)
    model = tb.fit_topics_in_batches(bags, "id", len(words), k=2, batch=16)
    best = {r["topic"]: r["term"] for r in model.topic_weights(spark, words)
            .groupBy("topic").agg(F.max_by("term", "weight").alias("term")).collect()}
    assert (best[0] in "sea sun sand wave beach") != (best[1] in "sea sun sand wave beach")
    rows = model.document_topics(bags.withColumn("topics0", F.lit(1))).collect()
    assert len(rows) == 70 and all(abs(sum(r["topics"]) - 1) < 1e-9 and r["topics0"] == 1 for r in rows)
    assert {r["topics"][0] > 0.5 for r in rows if r["id"] % 2 and r["id"] % 10} in ({True}, {False})
    assert [r["topics"] for r in rows if r["id"] == 10] == [[0.5, 0.5]]


def test_empty_table_and_one_folder_per_step(spark, monkeypatch):
    bags, words = toy(spark)
    none = tb.fit_topics_in_batches(bags.where("id < 0"), "id", len(words), k=2)
    assert none.weights.shape == (2, len(words))
    whole = tb.fit_topics_in_batches(bags, "id", len(words), k=2, passes=1, batch=8).weights
    monkeypatch.setattr(tb, "FOLDER_ROWS", 16)
    assert (tb.fit_topics_in_batches(bags, "id", len(words), k=2, passes=1, batch=8).weights == whole).all()
    rows, total = tb._write_batches(bags, "id", "features", 20, 8)
    plan = rows.where("folder = 1 and batch = 3")._jdf.queryExecution().executedPlan().toString()
    assert total == 70 and "PartitionFilters: [isnotnull(folder" in plan


def stages(spark, run):
    """Stages of the jobs that `run` starts."""
    spark.sparkContext.setJobGroup(name := str(random.random()), "")
    run()
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))


def test_a_step_is_one_stage(spark):
    bags, words = toy(spark)
    once, thrice = (stages(spark, lambda: tb.fit_topics_in_batches(bags, "id", len(words), k=2, passes=n, batch=16))
                    for n in (1, 3))
    assert thrice - once == 2 * 5


def test_many_small_batches_follow_one_another_in_one_stage(spark, monkeypatch):
    bags, words = toy(spark)
    models = []

    def fit(passes):
        models.append(tb.fit_topics_in_batches(bags, "id", len(words), k=2, passes=passes, batch=2).weights)

    assert stages(spark, lambda: fit(3)) - stages(spark, lambda: fit(1)) == 2
    assert np.allclose(models[0], plain_fit(counted(bags.withColumn("row_key", F.col("id")).select("row_key", "features")),
                                            len(words), 2, 20, 3, 2), rtol=1e-6, atol=1e-6)
    monkeypatch.setattr(tb, "FOLDER_ROWS", 36)
    fit(1)
    monkeypatch.setattr(tb, "CHAIN", 1000)
    fit(1)
    assert all((model == models[1]).all() for model in models[2:])


def test_documents_beside_each_other_do_not_matter():
    random_state = np.random.RandomState(5)
    sizes = np.array([1, 7, 40, 3, 1])
    beta, counts = random_state.rand(10, sizes.sum()), random_state.randint(1, 5, sizes.sum()).astype(float)
    gamma, added = tb.document_steps(counts, sizes, beta, 0.1)
    for d, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        alone = tb.document_steps(counts[a:b], sizes[d:d + 1], beta[:, a:b], 0.1)
        assert (alone[0][0] == gamma[d]).all() and (alone[1] == added[:, a:b]).all()
