"""Every registered query: equal to its SQL counterpart, or checked by its properties."""

import importlib

import pytest
from compare import compare

entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLE[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_topic_terms_are_ranked(spark, sf_dir):
    rows = QUERIES["topic_terms"](spark, sf_dir).orderBy("topic", "rank").collect()
    assert len(rows) == 10 * 50
    for a, b in zip(rows, rows[1:]):
        if a["topic"] == b["topic"]:
            assert a["weight"] >= b["weight"] and b["rank"] == a["rank"] + 1


def test_classifier_scores(spark, sf_dir):
    df = QUERIES["score_sentiment"](spark, sf_dir)
    assert df.where("sentiment_score not between 0.5 and 1").count() == 0
    assert df.where("sentiment not in ('POSITIVE', 'NEGATIVE')").count() == 0


def test_cross_validation_and_errors_agree(spark, sf_dir):
    folds = QUERIES["cross_validate"](spark, sf_dir).collect()
    wrong = QUERIES["wrong_predictions"](spark, sf_dir).groupBy("fold").count().collect()
    errors = {r["fold"]: r["count"] for r in wrong}
    rows = QUERIES["training_rows"](spark, sf_dir).count()
    sizes = [rows // 5 + (i < rows % 5) for i in range(5)]
    assert sorted(r["fold"] for r in folds) == [1, 2, 3, 4, 5]
    for r in folds:
        size = sizes[r["fold"] - 1]
        assert abs(r["accuracy"] - (1 - errors.get(r["fold"], 0) / size)) < 1e-9


def test_accuracy_test_row(spark, sf_dir):
    row = QUERIES["accuracy_test"](spark, sf_dir).first()
    assert row["n"] == 5 and abs(row["critical"] - 2.131847) < 1e-6


def test_fitted_topic_terms_are_ranked(spark, sf_dir):
    rows = QUERIES["topic_terms_fitted"](spark, sf_dir).orderBy("topic", "rank").collect()
    assert len(rows) == 10 * 50
    for a, b in zip(rows, rows[1:]):
        if a["topic"] == b["topic"]:
            assert a["weight"] >= b["weight"] and b["rank"] == a["rank"] + 1


def test_fitted_shares_and_dominant_topics(spark, sf_dir):
    shares = [r["share"] for r in QUERIES["topic_shares_fitted"](spark, sf_dir).collect()]
    assert len(shares) == 10 and abs(sum(shares) - 1) < 1e-9
    topics = QUERIES["dominant_topic_fitted"](spark, sf_dir)
    assert topics.count() == QUERIES["dominant_topic"](spark, sf_dir).count()
    assert topics.where("topic is null or topic not between 0 and 9").count() == 0


def test_fitted_relevance_covers_every_topic_and_term(spark, sf_dir):
    rows = QUERIES["term_relevance_fitted"](spark, sf_dir)
    assert rows.count() == 10 * QUERIES["vocabulary"](spark, sf_dir).count()
    assert rows.where("relevance is null or isnan(relevance)").count() == 0
