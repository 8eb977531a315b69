"""Labelling, sentiment, significance and topic jobs over preprocessed posts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession

from posttide.operators import classify, hypothesis, posts, ranking, sentiment, terms, topics
from posttide.session import materialize
from posttide.sources import readers, writers

# The largest number of posts scored per month.
SAMPLE_ROWS = 500_000


def label_posts(df: DataFrame, model: Model | Callable, n: int = SAMPLE_ROWS, seed: int = 0,
                batch_size: int = 32) -> DataFrame:
    """Sample each month down to `n` posts and add sentiment label and score.

    `model` is a fitted two-class Spark model, or a function that makes a Python one.
    """
    sample = ranking.sample_exact(df, n, ["year_month"], ["id"], seed)
    if isinstance(model, Model):
        return classify.score_with_classifier(sample, model)
    return classify.score_sentiment(sample, model, batch_size)


def run_labelling(spark: SparkSession, located: str, out: str, model: Model | Callable, fmt: str = "parquet",
                  **options) -> int:
    """Labels of located posts, one folder per month; located posts and labels are of format `fmt`.

    Returns how many texts the model failed on; their labels are empty. The labelled
    posts are written once before, so that the model runs once for rows and count.
    """
    labelled = materialize(label_posts(readers.read_preprocessed(spark, located, fmt), model, **options), "labelled")
    writers.write_labelled(labelled, out, fmt)
    return classify.failed_texts(labelled).first()["n_failed"]


def sentiment_reports(labelled: DataFrame, **period) -> dict[str, DataFrame]:
    """The tables of the sentiment charts and the bias test."""
    tested = materialize(hypothesis.sentiment_bias_test(labelled), "bias-test")
    return {
        "sentiment_counts": sentiment.sentiment_counts(labelled, **period),
        "sentiment_means": sentiment.sentiment_means(labelled, **period),
        "bias_test": tested.drop("p"),
        "rejected_ratio": hypothesis.rejected_ratio(tested),
    }


def topic_report(df: DataFrame, column: str = "text", k: int = topics.TOPICS, seed: int = topics.SEED,
                 top: int = 50, passes: int = topics.PASSES, ngram: int = 2, top_runs: int = 10,
                 mapped: bool = True) -> dict[str, DataFrame]:
    """Vocabulary, topic terms, shares, relevance, distances and map, documents with their main topic, top n-grams.

    The map is worked out at once, the other tables when they are read; `mapped=False` leaves it out.
    """
    tokens = materialize(terms.topic_words(df, column), "topic-words")
    vocab = materialize(terms.vocabulary(tokens), "vocabulary")
    bags = materialize(terms.bag_of_words(tokens, terms.term_list(vocab)).drop("tokens"), "bags")
    model = topics.fit_topics(bags, k, seed, passes=passes)
    documents = topics.dominant_topic(topics.document_topics(model, bags))
    weights = materialize(topics.topic_weights(model, vocab), "topic-weights")
    distances, shares = topics.topic_distances(weights), topics.topic_shares(documents)
    report = {"topic_map": topics.topic_map(distances, shares)} if mapped else {}
    return report | {
        "vocabulary": vocab,
        "topic_weights": weights,
        "topic_terms": topics.top_terms(weights, top),
        "topic_shares": shares,
        "topic_distances": distances,
        "term_relevance": topics.term_relevance(weights, vocab),
        "documents": documents.drop("features"),
        # Of the written table, which has the texts too: `df` may take a shuffle each time it is read.
        "top_ngrams": terms.top_ngrams(tokens, ngram, top_runs, column),
    }


def accuracy_report(training: DataFrame, estimator: Estimator | classify.Classifier | None = None, k: int = 5,
                    seed: int = 42, ids: Sequence[str] = ("textID",)) -> dict[str, DataFrame]:
    """Fold accuracies, their mean, the test against the baseline, and the texts predicted wrong."""
    labelled = posts.training_rows(training, ids)
    predicted = materialize(classify.fold_predictions(labelled, estimator, k, seed, ids), "fold-predictions")
    folds = classify.fold_accuracy(predicted)
    return {"folds": folds, "mean": classify.mean_accuracy(folds),
            "test": hypothesis.accuracy_test(folds),
            "wrong_predictions": classify.wrong_predictions(predicted)}
