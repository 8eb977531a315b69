import random

import pytest
from pyspark.sql import functions as F

from posttide.operators import classify


def rows(spark, n=60, labels=2):
    rng = random.Random(4)
    words = ["good", "fine", "bad", "poor", "so", "the", "a"]
    return spark.createDataFrame(
        [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6))) if i % 9 else None, float(i % labels))
         for i in range(n)], "id long, text string, label double")


WORDS = ["good", "fine", "bad", "poor", "so"]


@pytest.mark.parametrize("labels,k", [(2, 5), (3, 4)])
def test_equals_one_fit_per_fold(spark, labels, k):
    df = rows(spark, labels=labels)
    bayes = classify.bayes_classifier(WORDS)
    plain = classify.Classifier(bayes.prepare, bayes.estimator)
    found, wanted = (sorted(map(tuple, classify.fold_predictions(df, c, k).collect())) for c in (bayes, plain))
    assert found == wanted and len(found) == 60


def test_folds_and_counts_are_read_once_each(spark):
    plan = classify.fold_predictions(rows(spark), classify.bayes_classifier(WORDS), 5)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and text.count("parquet") == 2


def test_no_rows_no_known_words_and_one_fold(spark):
    df, bayes = rows(spark), classify.bayes_classifier(["unseen"])
    assert classify.fold_predictions(df.where("id < 0"), bayes).count() == 0
    found = classify.fold_predictions(df.where(F.col("id") < 10), bayes, 2)
    assert found.count() == 10 and found.where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        classify.fold_predictions(df, bayes, 1)


def test_no_text_travels_with_a_word(spark):
    plan = classify.fold_predictions(rows(spark), classify.bayes_classifier(WORDS), 5)
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Generate" in line and "regexp_extract_all" in line for line in lines)
