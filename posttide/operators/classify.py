"""Sentiment scoring, classifier training and cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide import schemas
from posttide.operators.ranking import assign_folds
from posttide.session import materialize

SCORED = T.StructType([T.StructField("sentiment", T.StringType()),
                       T.StructField("sentiment_score", T.DoubleType())])

# A task with fewer texts than this may fail on all of them.
LEAST_TEXTS = 32

#: The default classifier: weight of the penalty, most passes of the fit, and the relative gain at which it ends.
PENALTY, PASSES, TOLERANCE = 0.01, 500, 1e-12
#: A fit counts as optimal if no component of the gradient is larger.
FLAT = 1e-4

# A model takes texts and gives one (label, probability) per text.
TextModel = Callable[[list[str]], Sequence[tuple[str, float]]]


class ModelFailed(RuntimeError):
    """A caller's model failed on every text of a task: it is broken, not the texts."""


def _score_texts(model: TextModel, texts: list[str]) -> list[tuple[str | None, float | None]]:
    """Score a batch; if it fails, score its texts alone and leave the failing ones empty."""
    try:
        scored = list(model(texts))
        if len(scored) != len(texts):
            raise ValueError("one result per text expected")
        return [(label, float(score)) for label, score in scored]
    except Exception:
        if len(texts) == 1:
            return [(None, None)]
        return [result for t in texts for result in _score_texts(model, [t])]


def score_sentiment(df: DataFrame, make_model: Callable[[], TextModel], batch_size: int = 32,
                    column: str = "text") -> DataFrame:
    """Add `sentiment` and `sentiment_score` with a caller's model, in Arrow batches.

    `make_model` runs once per Python task. Texts that are NULL or make the
    model fail keep both columns NULL and the job goes on, but a task whose
    texts all fail, `LEAST_TEXTS` or more, stops the job. `failed_texts` counts
    the failures.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, seen, failed = make_model(), 0, 0
        for series in batches:
            given = series[series.notna()]
            results = [r for at in range(0, len(given), batch_size)
                       for r in _score_texts(model, given.iloc[at:at + batch_size].tolist())]
            seen += len(results)
            failed += sum(label is None for label, _ in results)
            out = pd.DataFrame(results, columns=SCORED.names, index=given.index, dtype=object)
            out = out.reindex(series.index)
            yield out.astype({"sentiment_score": "float64"}).where(out.notna(), None)
        if failed == seen >= LEAST_TEXTS:
            raise ModelFailed(f"the model failed on all {seen} texts of a task")

    udf = F.pandas_udf(run, returnType=SCORED)
    return (df.withColumn("_scored", udf(F.col(column)))
            .withColumns({name: F.col(f"_scored.{name}") for name in SCORED.names})
            .drop("_scored"))


def failed_texts(scored: DataFrame, column: str = "text") -> DataFrame:
    """One row, `n_failed`: texts that are there but got no label."""
    return scored.agg(F.count(F.when(F.col(column).isNotNull() & F.col("sentiment").isNull(), 1)).alias("n_failed"))


def score_with_classifier(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The same columns from a fitted two-class Spark model (label 1 is positive)."""
    inputs = df.select(F.struct(*df.columns).alias("_row"), F.coalesce(column, F.lit("")).alias("text"))
    given = F.col(f"_row.{column}").isNotNull()
    label = F.when(F.col("prediction") == 1.0, schemas.POSITIVE).otherwise(schemas.NEGATIVE)
    best = F.array_max(vector_to_array("probability"))
    return model.transform(inputs).select(
        "_row.*", F.when(given, label).alias("sentiment"), F.when(given, best).alias("sentiment_score"))


class Classifier:
    """A classifier in two halves: `prepare` turns texts into features row by row and needs no fit, so it runs
    once for all folds; `estimator` is fitted on `label` and what `prepare` adds."""

    def __init__(self, prepare: Transformer, estimator: Estimator):
        self.prepare, self.estimator = prepare, estimator


def default_classifier(features: int = 1 << 16, max_iter: int = PASSES, penalty: float = PENALTY) -> Classifier:
    """Hashed TF-IDF words into a logistic regression; expects `text` and `label`.

    The squared coefficients of the features in units of their standard deviation, not the intercept, are penalised,
    so there is one best model even where words tell the classes apart perfectly; `fit_certificate` says how near the
    fit has come to it.
    """
    words = RegexTokenizer(inputCol="text", outputCol="_words", gaps=False, pattern=r"[\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    return Classifier(PipelineModel([words, counts]),
                      Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"),
                                       LogisticRegression(maxIter=max_iter, regParam=penalty, tol=TOLERANCE)]))


class BayesClassifier(Classifier):
    """Naive Bayes over word counts. What a fold must not see is subtracted from counts over all folds."""

    def __init__(self, prepare: Transformer, estimator: Estimator, words: Sequence[str], pattern: str):
        super().__init__(prepare, estimator)
        self.words, self.pattern = list(words), pattern

    def fold_predictions(self, folds: DataFrame, k: int, ids: Sequence[str]) -> DataFrame:
        """Every row of `folds` (ids, text, label, fold) predicted by the counts of the other folds.

        One aggregation counts the words per fold and label; a training set is the total less its own fold, so no
        fold is fitted or read by itself. The table of logarithms has a row per fold with a number per word and label,
        and is broadcast; a row sums its own bag with it, so no word travels with the text it is from. All labels of
        the table count as classes of every training set. The lowest label wins ties, as in the fitted model.
        """
        spark = folds.sparkSession
        sizes = {(r[0], r[1]): r[2] for r in folds.groupBy("fold", "label").count().collect()}  # k times labels
        labels, numbers = sorted({label for _, label in sizes}), range(1, k + 1)
        if not labels:
            return folds.select(*ids, "text", "label", "fold", F.lit(None).cast("double").alias("prediction"))
        tokens = F.regexp_extract_all(F.lower("text"), F.lit(self.pattern), F.lit(0))
        known = spark.createDataFrame(list(enumerate(self.words)), "place int, term string")
        own = {(f, i): F.count_if((F.col("fold") == f) & (F.col("label") == label)).alias(f"own_{f}_{i}")
               for f in numbers for i, label in enumerate(labels)}
        seen = (folds.select("fold", "label", F.explode(tokens).alias("term"))
                .join(F.broadcast(known), "term").groupBy("place").agg(*own.values()))
        counts = materialize(known.select("place").join(seen, "place", "left").na.fill(0), "fold-counts")
        mass = counts.agg(*[F.coalesce(F.sum(f"own_{f}_{i}"), F.lit(0)).alias(f"own_{f}_{i}") for f, i in own]).first()

        def others(f: int, i: int, of: Callable[[int, int], object]) -> object:
            return reduce(lambda a, b: a + b, [of(g, i) for g in numbers if g != f])

        def weight(f: int, i: int) -> Column:
            seen = others(f, i, lambda g, i: F.col(f"own_{g}_{i}"))
            return F.log(seen + 1) - F.log(F.lit(float(others(f, i, lambda g, i: mass[f"own_{g}_{i}"]) + len(self.words))))

        def prior(f: int, i: int) -> float:
            rows = [others(f, j, lambda g, j: sizes.get((g, labels[j]), 0)) for j in range(len(labels))]
            return math.log(rows[i] + 1) - math.log(sum(rows) + len(labels))

        def in_order(i: int) -> Column:
            return F.transform(F.array_sort(F.collect_list(F.struct("place", f"w{i}"))), lambda e: e[f"w{i}"])

        table = counts.select("place", F.explode(F.array(*[
            F.struct(F.lit(f).alias("fold"), *[weight(f, i).alias(f"w{i}") for i in range(len(labels))])
            for f in numbers])).alias("e")).select("place", "e.*").groupBy("fold").agg(
            *[in_order(i).alias(f"_w{i}") for i in range(len(labels))])
        bag = CountVectorizerModel.from_vocabulary(self.words, inputCol="_words", outputCol="_bag")
        vector = F.unwrap_udt("_bag")

        def added(i: int) -> Column:
            each = F.zip_with(vector["indices"], vector["values"], lambda place, n: n * F.get(f"_w{i}", place))
            return F.coalesce(F.aggregate(each, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))

        given = bag.transform(folds.select(*ids, "text", "label", "fold", tokens.alias("_words")))
        # Rows of one key, label and fold count as one text.
        summed = (given.join(F.broadcast(table), "fold", "left")
                  .select(*ids, "text", "label", "fold", *[added(i).alias(f"w{i}") for i in range(len(labels))])
                  .groupBy(*ids, "label", "fold")
                  .agg(F.first("text").alias("text"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(labels))]))
        priors = F.array(*[F.array(*[F.lit(prior(f, i)) for f in numbers]) for i in range(len(labels))])
        scores = F.array(*[F.col(f"w{i}") + F.get(F.get(priors, F.lit(i)), F.col("fold") - 1)
                           for i in range(len(labels))])
        best = F.array_position(scores, F.array_max(scores)).cast("int")
        return summed.select(*ids, "text", "label", "fold",
                             F.get(F.array(*map(F.lit, labels)), best - 1).alias("prediction"))


def bayes_classifier(words: Sequence[str], pattern: str = r"[a-z]+") -> BayesClassifier:
    """Counts of the given words into a multinomial naive Bayes model, which has a closed form."""
    split = RegexTokenizer(inputCol="text", outputCol="_words", gaps=False, pattern=pattern)
    counts = CountVectorizerModel.from_vocabulary(list(words), inputCol="_words", outputCol="features")
    return BayesClassifier(PipelineModel([split, counts]), NaiveBayes(smoothing=1.0), words, pattern)


def _labelled(df: DataFrame, *extra: str) -> DataFrame:
    """Rows with a label; NULL texts are empty."""
    return df.where(F.col("label").isNotNull()).select(
        *extra, F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))


def _halves(estimator: Estimator | Classifier | None) -> Classifier:
    if isinstance(estimator, Classifier):
        return estimator
    return Classifier(PipelineModel([]), estimator) if estimator else default_classifier()


def train_classifier(df: DataFrame, estimator: Estimator | Classifier | None = None) -> PipelineModel:
    """Fit on (text, label) rows; rows without label are left out, NULL texts are empty.

    The features are written once, so that no pass of the fit reads or cuts texts again.
    """
    parts = _halves(estimator)
    rows = materialize(parts.prepare.transform(_labelled(df)).drop("_words"), "training-features")
    return PipelineModel([parts.prepare, parts.estimator.fit(rows)])


def _regression(model: PipelineModel) -> LogisticRegressionModel:
    """The logistic regression that a fitted default classifier ends with."""
    last = model.stages[-1]
    while isinstance(last, PipelineModel):
        last = last.stages[-1]
    if not isinstance(last, LogisticRegressionModel) or last.numClasses != 2:
        raise ValueError("a logistic regression of two classes is needed")
    return last


def _residuals(df: DataFrame, model: PipelineModel) -> DataFrame:
    """(place, value, n_words, label, probability) of every labelled row: its features and its chance of label 1."""
    vector = F.unwrap_udt("features")
    return materialize(model.transform(_labelled(df)).select(
        vector["indices"].alias("place"), vector["values"].alias("value"), F.size("_words").alias("n_words"), "label",
        F.get(vector_to_array("probability"), F.lit(1)).alias("probability")), "residuals")


def _gradient(rows: DataFrame, fitted: LogisticRegressionModel, penalty: float) -> DataFrame:
    """Rows and coefficients go into one aggregation per feature, combined before the shuffle; nothing is joined."""
    n = rows.count()
    miss = F.col("probability") - F.col("label")
    data = rows.select(F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("feature"), F.lit(1.0).alias("x"), miss.alias("miss"), F.lit(0.0).alias("weight"))),
        F.transform(F.arrays_zip("place", "value"), lambda e: F.struct(
            e["place"].alias("feature"), e["value"].alias("x"), miss.alias("miss"), F.lit(0.0).alias("weight")))
    )).alias("e")).select("e.*")
    weights = [(i, 0.0, 0.0, w) for i, w in enumerate(fitted.coefficients.toArray().tolist()) if w]
    own = rows.sparkSession.createDataFrame(weights, "feature int, x double, miss double, weight double")
    sums = data.unionByName(own).groupBy("feature").agg(
        (F.sum(F.col("x") * F.col("miss")) / max(n, 1)).alias("slope"), F.sum("weight").alias("weight"),
        F.sqrt(F.greatest(F.sum(F.col("x") * F.col("x")) - F.pow(F.sum("x"), 2) / max(n, 1), F.lit(0.0))
               / max(n - 1, 1)).alias("unit"))
    return sums.select("feature", F.when(F.col("feature") < 0, F.col("slope")).when(
        F.col("unit") > 0, F.col("slope") / F.col("unit") + penalty * F.col("unit") * F.col("weight"))
        .otherwise(0.0).alias("gradient"))


def loss_gradient(df: DataFrame, model: PipelineModel, penalty: float = PENALTY) -> DataFrame:
    """(feature, gradient) at a default classifier fitted on the same rows; feature -1 is the intercept.

    The loss is the mean negative log-likelihood of the (text, label) rows plus `penalty` / 2 times the squared length
    of the coefficients, features measured in standard deviations. It is convex, so a gradient of zero everywhere
    proves the fit, however it was found. Features that no row and no coefficient has are left out; their gradient is
    zero, as is that of a feature that is the same in all rows. Rows without label are left out, NULL texts are empty.
    """
    return _gradient(_residuals(df, model), _regression(model), penalty)


def fit_certificate(df: DataFrame, model: PipelineModel, penalty: float = PENALTY) -> DataFrame:
    """One row: n_rows, n_positive, n_words, mean_probability (of label 1), largest_gradient and is_optimal.

    At the best model the mean probability equals the share of label 1, since the intercept is not penalised.
    """
    rows = _residuals(df, model)
    counted = rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1.0).alias("n_positive"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.avg("probability").alias("mean_probability"))
    steepest = _gradient(rows, _regression(model), penalty).agg(
        F.coalesce(F.max(F.abs("gradient")), F.lit(0.0)).alias("largest_gradient"))
    one = F.lit(1).alias("one")
    return (counted.select("*", one).join(steepest.select("*", one), "one").drop("one")
            .withColumn("is_optimal", F.col("largest_gradient") < FLAT))


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row, `accuracy`: share of rows predicted right."""
    return predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))


def wrong_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("prediction") != F.col("label"))


def fold_predictions(df: DataFrame, estimator: Estimator | Classifier | None = None, k: int = 5, seed: int = 42,
                     ids: Sequence[str] = ("id",)) -> DataFrame:
    """Every row predicted by the model trained on the other folds: ids, text, label, fold, prediction.

    Texts become features once, before the folds; a fold only fits what must be fitted, and naive Bayes fits none.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    parts = _halves(estimator)
    assigned = assign_folds(_labelled(df, *ids), k, seed, ids)
    if isinstance(parts, BayesClassifier):
        return parts.fold_predictions(materialize(assigned, "folds"), k, ids)
    folds = materialize(parts.prepare.transform(assigned).drop("_words"), "folds")
    predicted = []
    for fold in range(1, k + 1):
        model = parts.estimator.fit(folds.where(F.col("fold") != fold))
        predicted.append(model.transform(folds.where(F.col("fold") == fold))
                         .select(*ids, "text", "label", "fold", "prediction"))
    return reduce(DataFrame.unionByName, predicted)


def fold_accuracy(predictions: DataFrame) -> DataFrame:
    """(fold, accuracy), one row per fold."""
    right = (F.col("prediction") == F.col("label")).cast("int")
    return predictions.groupBy("fold").agg(F.avg(right).alias("accuracy"))


def cross_validate(df: DataFrame, estimator: Estimator | Classifier | None = None, k: int = 5, seed: int = 42,
                   ids: Sequence[str] = ("id",)) -> DataFrame:
    """(fold, accuracy), one row per fold."""
    return fold_accuracy(fold_predictions(df, estimator, k, seed, ids))


def mean_accuracy(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("mean_accuracy"))
