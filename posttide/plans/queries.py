"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttide import schemas
from posttide.functions import dates, scores, text
from posttide.operators import (classify, hypothesis, lemmas, places, posts, ranking, sentiment, tagging, terms,
                                topic_batches, topics)
from posttide.plans import adapters, preprocess, reports
from posttide.session import materialize, scratch_path
from posttide.sources import ledger, readers, writers

# The labelled table covers other years than the jobs' own period.
PERIOD = {"start": date(1996, 3, 1), "end": date(1997, 4, 30)}
SAMPLE = 100
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.run(spark, sf, adapters.POSTS)


def english(spark: SparkSession, sf: str) -> DataFrame:
    return posts.filter_language(raw_posts(spark, sf))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.run(spark, sf, adapters.GAZETTEER)


def place_index_table(spark: SparkSession, sf: str, **options) -> DataFrame:
    return materialize(places.build_place_index(gazetteer(spark, sf), **options), "place-index")


def labelled_posts(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.run(spark, sf, adapters.LABELLED)


def training(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.run(spark, sf, adapters.TRAINING)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon read off the documents: short words, some with a lemma of their own."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    words = documents.select(F.explode(text.words(F.col("text"), r"[a-z]{3,}")).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("freq")).where(F.length("w") <= 5)
    pos = F.element_at(F.array(F.lit("n"), F.lit("v"), F.lit("a")), F.length("w") % 3 + 1)
    lemma = F.when((F.length("w") == 5) & F.endswith("w", F.lit("n")), F.left("w", F.lit(4))).otherwise(F.col("w"))
    return counted.select(F.col("w").alias("surface"), pos.alias("pos"), lemma.alias("lemma"), "freq")


def tagged_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as a tagged table. A word's class depends on it and on the word before, so most words have
    several classes."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    size = F.transform("tokens", lambda t, i: F.length(t) + F.coalesce(F.length(F.get("tokens", i - 1)), F.lit(0)))
    known = F.array(*[F.lit(c) for c in tagging.CLASSES])
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    return conversations.select(tokens.alias("tokens")).withColumn(
        "classes", F.transform(size, lambda n: F.get(known, n % len(tagging.CLASSES))))


def class_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon read off the documents in which a form has other lemmas as a noun, a verb or an adjective."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    words = documents.select(F.explode(text.words(F.col("text"), r"[a-z]{4,}")).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("freq")).where(F.length("w") <= 6)
    endings = F.array(*[F.struct(F.lit(c).alias("pos"), F.lit(e).alias("ending"))
                        for c, e in (("n", "e"), ("v", "n"), ("a", "o"), ("v", "e"))])
    each = counted.select("w", "freq", F.explode(endings).alias("e")).where(F.endswith("w", F.col("e.ending")))
    return each.select(F.col("w").alias("surface"), "e.pos",
                       F.expr("left(w, length(w) - CASE WHEN e.pos = 'v' THEN 1 ELSE 2 END)").alias("lemma"), "freq")


def flat(df: DataFrame) -> DataFrame:
    """Place struct and arrays as plain columns, for comparing."""
    if "place" in df.columns:
        df = df.select("*", "place.*").drop("place")
    lists = [c for c, t in df.dtypes if t.startswith("array")]
    return df.withColumns({c: F.array_join(c, "|") for c in lists}) if lists else df


# Projections and filters

@query
def language_filter(spark, sf):
    return posts.select_post_columns(posts.filter_language(raw_posts(spark, sf))).select(
        "location", "tweetcreatedts", "text", "hashtags")


@query
def post_projection(spark, sf):
    df = posts.filter_valid_hashtags(english(spark, sf)).withColumn(
        "place", F.lit(None).cast(schemas.PLACE_TYPE))
    return flat(posts.build_preprocessed(df)).drop("city", "state", "country", "lat", "lon", "file", "pos")


@query
def hashtag_extract(spark, sf):
    return flat(posts.filter_valid_hashtags(raw_posts(spark, sf)).select("row_key", "hashtags"))


@query
def popularity_reach(spark, sf):
    return raw_posts(spark, sf).select(
        "row_key",
        scores.popularity_score(F.col("retweetcount"), F.col("favorite_count")).alias("popularity_score"),
        scores.reach_score(F.col("following"), F.col("followers")).alias("reach_score"))


@query
def post_month(spark, sf):
    return raw_posts(spark, sf).select("row_key", dates.post_month(F.col("tweetcreatedts")).alias("year_month"))


@query
def file_month(spark, sf):
    return readers.assign_file_month(raw_posts(spark, sf)).select("row_key", "file", "year_month")


@query
def date_range(spark, sf):
    return posts.filter_dates(labelled_posts(spark, sf), **PERIOD).select(
        "id", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.date_format(dates.month_of(F.col("date")), "yyyy-MM-dd").alias("month"))


@query
def label_signs(spark, sf):
    return sentiment.with_sign(labelled_posts(spark, sf)).select("id", "sign")


@query
def training_rows(spark, sf):
    return posts.training_rows(training(spark, sf), ["textID"])


# Text

@query
def clean_light(spark, sf):
    return raw_posts(spark, sf).select("row_key", text.clean_light(F.col("text")).alias("text"))


@query
def clean_each_pattern(spark, sf):
    t = F.col("text")
    return raw_posts(spark, sf).select(
        "row_key", text.strip_urls(t).alias("urls"), text.strip_mentions(t).alias("mentions"),
        text.strip_hashtags(t).alias("hashtags"), text.strip_emoji(t).alias("emoji"),
        text.strip_smileys(t).alias("smileys"), text.strip_numbers(t).alias("numbers"),
        text.strip_leftovers(t).alias("leftovers"), text.strip_punctuation(t).alias("punctuation"))


@query
def tokens_no_stopwords(spark, sf):
    return raw_posts(spark, sf).select(
        "row_key", F.array_join(lemmas.heavy_tokens(F.col("text")), " ").alias("tokens"))


@query
def token_classes(spark, sf):
    return lemmas.tag_tokens(lexicon(spark, sf))


@query
def lemma_table(spark, sf):
    return lemmas.lemma_forms(lexicon(spark, sf))


@query
def clean_heavy(spark, sf):
    cleaned = lemmas.clean_heavy(english(spark, sf).select("row_key", "text"), lexicon(spark, sf))
    return cleaned.select("row_key", F.array_join("text", " ").alias("tokens"))


@query
def token_classes_in_context(spark, sf):
    """The best sequence of classes of every English post, one letter a token."""
    tokens = english(spark, sf).select("row_key", lemmas.heavy_tokens(F.col("text"), []).alias("tokens"))
    found = tagging.tag_in_context(tokens, tagging.train_tagger(tagged_texts(spark, sf)))
    return found.select("row_key", F.array_join("classes", "").alias("classes"))


@query
def clean_heavy_in_context(spark, sf):
    """Heavy cleaning with lemmas by word and class."""
    cleaned = tagging.clean_heavy_in_context(
        english(spark, sf).select("row_key", "text"), tagging.train_tagger(tagged_texts(spark, sf)),
        materialize(class_lexicon(spark, sf), "lexicon"))
    return cleaned.select("row_key", F.array_join("text", " ").alias("tokens"))


# Places

@query
def gazetteer_merge(spark, sf):
    return places.merge_gazetteer(adapters.run(spark, sf, adapters.PLACES),
                                  adapters.run(spark, sf, adapters.STATES))


@query
def gazetteer_merge_strict(spark, sf):
    return places.merge_gazetteer(adapters.run(spark, sf, adapters.PLACES),
                                  adapters.run(spark, sf, adapters.STATES), null_safe=False)


@query
def gazetteer_projection(spark, sf):
    return places.project_gazetteer(gazetteer(spark, sf))


@query
def place_entries(spark, sf):
    return flat(places.place_entries(gazetteer(spark, sf)))


@query
def place_index(spark, sf):
    return flat(places.build_place_index(gazetteer(spark, sf)))


@query
def resolve_location(spark, sf):
    found = places.resolve_location(raw_posts(spark, sf), place_index_table(spark, sf))
    return flat(found.select("row_key", "location", "place"))


@query
def resolve_location_any_case(spark, sf):
    index = place_index_table(spark, sf, dedupe=True, case_insensitive=True)
    found = places.resolve_location(raw_posts(spark, sf), index, case_insensitive=True)
    return flat(found.select("row_key", "location", "place"))


def preprocessed(spark, sf, **options):
    return preprocess.preprocess(raw_posts(spark, sf), place_index_table(spark, sf), **options)


@query
def located_posts(spark, sf):
    return posts.filter_located(preprocessed(spark, sf)).select(
        "row_key", "city", "state", "country", "lat", "lon", "date")


# Numbering, folds, samples

@query
def month_ids(spark, sf):
    numbered = ranking.assign_ids(readers.assign_file_month(raw_posts(spark, sf)), block_rows=64)
    return numbered.select("row_key", "year_month", "file", "id")


@query
def fold_assignment(spark, sf):
    return ranking.assign_folds(raw_posts(spark, sf), ids=["row_key"]).select("row_key", "fold")


@query
def sample_exact(spark, sf):
    return ranking.sample_exact(labelled_posts(spark, sf), SAMPLE).select("id", "year_month")


# Whole preprocessing jobs

@query
def preprocessed_light(spark, sf):
    numbered = ranking.assign_ids(preprocessed(spark, sf))
    return flat(numbered.select("year_month", *schemas.PREPROCESSED_COLUMNS))


@query
def preprocessed_heavy(spark, sf):
    rows = preprocessed(spark, sf, mode=preprocess.HEAVY, lexicon=lexicon(spark, sf))
    return rows.select("row_key", "year_month", "country", F.array_join("text", " ").alias("text"),
                       "reach_score")


# Sources and sinks: write to the shared folder, read back

@query
def union_labelled(spark, sf):
    df = labelled_posts(spark, sf)
    old = df.where("year_month < '1998_01'").select("id", "country", "date", "sentiment")
    return posts.union_all([old, df.where("year_month >= '1998_01'").drop("year_month")])


@query
def csv_by_header(spark, sf):
    """Exports with three column orders, one of them without a column, stacked by name."""
    path = scratch_path(spark, "csv")
    raw = raw_posts(spark, sf).select("row_key", *schemas.RAW_POST_COLUMNS)
    orders = [raw.columns, raw.columns[::-1], sorted(raw.drop("followers").columns)]
    for k, order in enumerate(orders):
        raw.where(F.col("row_key") % 3 == k).select(*order).write.options(**writers.CSV_OPTIONS).csv(f"{path}/{k}")
    back = readers.read_csv_by_header(spark, path, ["row_key", *schemas.RAW_POST_COLUMNS], recursive=True)
    return back.select(F.col("row_key").cast("bigint").alias("row_key"), "location", "language",
                       F.md5(F.col("text").cast("binary")).alias("text_md5"), "followers")


@query
def row_file_counts(spark, sf):
    return readers.row_file_counts(raw_posts(spark, sf))


@query
def gazetteer_csv(spark, sf):
    """Several part files, written in the order of the row ids, which the reader finds again."""
    path = scratch_path(spark, "gazetteer")
    writers.write_gazetteer(gazetteer(spark, sf), path)
    return readers.read_gazetteer(spark, path)


@query
def training_csv(spark, sf):
    path = scratch_path(spark, "training")
    training(spark, sf).write.options(**writers.CSV_OPTIONS).csv(path)
    return readers.read_training(spark, path).select(
        "textID", F.md5(F.col("text").cast("binary")).alias("text_md5"), "sentiment")


@query
def labelled_csv(spark, sf):
    """Labelled posts as CSV folders and back, months from the folders."""
    path = scratch_path(spark, "labelled")
    writers.write_labelled(labelled_posts(spark, sf), path, "csv")
    return readers.read_labelled(spark, path, "csv").select(
        "id", "country", "date", "year_month", "sentiment", "sentiment_score")


@query
def write_read_partitioned(spark, sf):
    """Two appends to one table: ids of the second go on where the first ended."""
    path = scratch_path(spark, "posts")
    rows = materialize(preprocessed(spark, sf), "preprocessed")
    writers.write_posts(rows.where("file < 'src15'"), path)
    writers.write_posts(rows.where("file >= 'src15'"), path)
    return flat(readers.read_preprocessed(spark, path).select("year_month", "id", "text", "country", "date"))


@query
def append_retried(spark, sf):
    """Two jobs to one table, the first of them run again after the second."""
    path = scratch_path(spark, "appended")
    rows = materialize(preprocessed(spark, sf), "preprocessed")
    early, late = rows.where("file < 'src15'"), rows.where("file >= 'src15'")
    for part, job in ((early, "early"), (late, "late"), (early, "early")):
        ledger.append_once(part, path, job)
    return flat(ledger.read_appended(spark, path).select("year_month", "id", "text", "country", "date"))


@query
def write_read_located(spark, sf):
    path = scratch_path(spark, "located")
    writers.write_located(preprocessed(spark, sf), path)
    return readers.read_preprocessed(spark, path).select("year_month", "id", "country", "lat", "lon", "date")


@query
def read_one_month(spark, sf):
    path = scratch_path(spark, "labelled")
    writers.write_labelled(labelled_posts(spark, sf), path)
    return readers.read_month(spark, path, "1996_03").select("id", "country", "sentiment", "sentiment_score")


@query
def write_by_country(spark, sf):
    path = scratch_path(spark, "by-country")
    by_year = F.concat(F.left("year_month", F.lit(5)), F.lit("01"))
    writers.write_by_country(labelled_posts(spark, sf).withColumn("year_month", by_year), path)
    return readers.read_labelled(spark, path).groupBy("country", "year_month").agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum"))


# Aggregates and tests

@query
def sentiment_counts(spark, sf):
    found = sentiment.sentiment_counts(labelled_posts(spark, sf), **PERIOD)
    return found.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query
def sentiment_means(spark, sf):
    found = sentiment.sentiment_means(labelled_posts(spark, sf), **PERIOD)
    return found.select("country", F.date_format("month", "yyyy-MM-dd").alias("month"),
                        F.round("Negative", 6).alias("Negative"), F.round("Positive", 6).alias("Positive"))


@query
def country_totals(spark, sf):
    return sentiment.country_totals(sentiment.sentiment_counts(labelled_posts(spark, sf), **PERIOD, k=None))


@query
def top_countries(spark, sf):
    return sentiment.top_countries(labelled_posts(spark, sf))


@query
def top_countries_labelled(spark, sf):
    return sentiment.top_countries_labelled(labelled_posts(spark, sf))


@query
def top_country_posts(spark, sf):
    df = labelled_posts(spark, sf)
    return posts.restrict_to(df, sentiment.top_countries(df, 5)).select("id", "country")


@query
def negative_ratio(spark, sf):
    return sentiment.negative_ratio(labelled_posts(spark, sf))


@query
def sentiment_ttest(spark, sf):
    tested = hypothesis.ttest_1samp(sentiment.with_sign(labelled_posts(spark, sf)), ["country"], "sign")
    return tested.select("country", "n_posts", "n", F.round("t", 6).alias("t"))


@query
def sentiment_ttest_omit(spark, sf):
    tested = hypothesis.ttest_1samp(sentiment.with_sign(labelled_posts(spark, sf)), ["country"], "sign",
                                    popmean=0.4, nulls="omit")
    return tested.select("country", "n_posts", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"))


@query
def sentiment_bias_test(spark, sf):
    return hypothesis.sentiment_bias_test(labelled_posts(spark, sf)).drop("p")


@query
def rejected_ratio(spark, sf):
    return hypothesis.rejected_ratio(hypothesis.sentiment_bias_test(labelled_posts(spark, sf)))


# Terms and topics

@query
def term_stats(spark, sf):
    return terms.term_stats(terms.topic_words(raw_posts(spark, sf)))


@query
def top_ngrams(spark, sf):
    return terms.top_ngrams(raw_posts(spark, sf))


@query
def trigram_counts(spark, sf):
    return terms.ngram_counts(raw_posts(spark, sf), 3)


@query
def vocabulary(spark, sf):
    return terms.vocabulary(terms.topic_words(raw_posts(spark, sf)))


def bags(spark, sf):
    """Bags of all posts, the vocabulary, and its terms in order."""
    tokens = materialize(terms.topic_words(raw_posts(spark, sf)).select("row_key", "tokens"), "topic-words")
    vocab = materialize(terms.vocabulary(tokens), "vocabulary")
    words = terms.term_list(vocab)
    return terms.bag_of_words(tokens, words), vocab, words


@query
def bag_of_words(spark, sf):
    found, _, words = bags(spark, sf)
    return terms.bag_rows(found, words, "row_key")


# The tables of a topic model, from weights and shares that a rule gives for the terms and posts at hand.

def topic_numbers():
    return F.sequence(F.lit(0), F.lit(topics.TOPICS - 1))


def weights_by_rule(vocab: DataFrame) -> DataFrame:
    each = vocab.select("term", "term_freq", F.explode(topic_numbers()).alias("topic"))
    raw = F.col("term_freq") * ((F.length("term") * 7 + F.col("topic") * 3) % 11 + 1)
    total = F.sum("raw").over(Window.partitionBy("topic"))
    return each.withColumn("raw", raw).select("topic", "term", (F.col("raw") / total).alias("weight"))


def shares_by_rule(found: DataFrame) -> DataFrame:
    raw = F.transform(topic_numbers(), lambda k: (F.col("row_key") * 31 + k * 17) % 97 + 1)
    total = F.aggregate("raw", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.withColumn("raw", raw).withColumn("topics", F.transform("raw", lambda x: x / total))


@query
def topic_terms(spark, sf):
    _, vocab, _ = bags(spark, sf)
    return topics.top_terms(weights_by_rule(vocab), 50)


@query
def topic_shares(spark, sf):
    found, _, _ = bags(spark, sf)
    return topics.topic_shares(shares_by_rule(found)).select("topic", F.round("share", 9).alias("share"))


@query
def term_relevance(spark, sf):
    _, vocab, _ = bags(spark, sf)
    found = topics.term_relevance(weights_by_rule(vocab), vocab)
    return found.select("topic", "term", F.round("relevance", 6).alias("relevance"))


@query
def dominant_topic(spark, sf):
    found, _, _ = bags(spark, sf)
    return topics.dominant_topic(shares_by_rule(found)).select("row_key", "topic")


@query
def topic_distances(spark, sf):
    _, vocab, _ = bags(spark, sf)
    found = topics.topic_distances(materialize(weights_by_rule(vocab), "topic-weights"))
    return found.select("topic", "other", F.round("distance", 9).alias("distance"))


# The same tables of the fitted model, all passes over the posts. No SQL: a fit cannot be repeated there.

def fitted_topics(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return reports.topic_report(raw_posts(spark, sf).select("row_key", "text"), mapped=False)[name]


@query
def topic_terms_fitted(spark, sf):
    return fitted_topics(spark, sf, "topic_terms")


@query
def topic_shares_fitted(spark, sf):
    return fitted_topics(spark, sf, "topic_shares")


@query
def term_relevance_fitted(spark, sf):
    return fitted_topics(spark, sf, "term_relevance")


@query
def dominant_topic_fitted(spark, sf):
    return fitted_topics(spark, sf, "documents").select("row_key", "topic")


def topics_in_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Weights and documents of a model fitted 128 posts at a time."""
    found, _, words = bags(spark, sf)
    model = topic_batches.fit_topics_in_batches(found.drop("tokens"), "row_key", len(words))
    return (materialize(model.topic_weights(spark, words), "topic-weights"),
            materialize(model.document_topics(found.drop("tokens")), "document-topics"))


@query
def topic_terms_in_batches(spark, sf):
    return topics.top_terms(topics_in_batches(spark, sf)[0], 50)


@query
def topic_map_in_batches(spark, sf):
    weights, documents = topics_in_batches(spark, sf)
    return topics.topic_map(topics.topic_distances(weights), topics.topic_shares(documents))


@query
def topic_model(spark, sf):
    """What must hold of the fitted model: every post has shares that sum to 1, every topic weighs every term."""
    report = reports.topic_report(raw_posts(spark, sf).select("row_key", "text"), mapped=False)
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    documents = report["documents"].agg(
        F.count("*").alias("n_posts"), F.count(F.when(F.abs(total - 1) < 1e-6, 1)).alias("n_sum_to_one"))
    weights = report["topic_weights"].agg(
        F.count_distinct("topic").alias("n_topics"), F.count_distinct("term").alias("n_terms"),
        F.count("*").alias("n_weights"), F.round(F.sum("weight"), 6).alias("weight_sum"))
    one = F.lit(1).alias("one")
    return documents.select("*", one).join(weights.select("*", one), "one").drop("one")


# Models

def training_posts(spark, sf):
    return materialize(posts.training_rows(training(spark, sf), ["textID"]), "training-rows")


def word_bayes(rows: DataFrame) -> classify.Classifier:
    """Naive Bayes over the vocabulary of the training texts (the 5,000 most frequent words that three or more of them
    have): a model in closed form, which SQL can repeat."""
    words = rows.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return classify.bayes_classifier(terms.term_list(terms.vocabulary(words)))


@query
def score_sentiment(spark, sf):
    """A classifier trained on all labelled texts, over all posts."""
    rows = training_posts(spark, sf)
    model = classify.train_classifier(rows, word_bayes(rows))
    return classify.score_with_classifier(raw_posts(spark, sf), model).select(
        "row_key", "sentiment", F.round("sentiment_score", 4).alias("sentiment_score"))


@query
def score_sentiment_default(spark, sf):
    """The default classifier trained on all labelled texts, over all posts."""
    model = classify.train_classifier(training_posts(spark, sf))
    return classify.score_with_classifier(raw_posts(spark, sf), model).select(
        "row_key", "sentiment", F.round("sentiment_score", 4).alias("sentiment_score"))


@query
def default_classifier(spark, sf):
    """What proves the default classifier's fit on all labelled texts: its gradient vanishes."""
    rows = training_posts(spark, sf)
    return classify.fit_certificate(rows, classify.train_classifier(rows)).select(
        "n_rows", "n_positive", "n_words", F.round("mean_probability", 4).alias("mean_probability"), "is_optimal")


@query
def score_sentiment_batches(spark, sf):
    """A caller's Python model in Arrow batches; it fails on texts without any vowel."""
    return classify.score_sentiment(english(spark, sf), vowel_model).select(
        "row_key", "sentiment", F.round("sentiment_score", 4).alias("sentiment_score"))


def vowel_model() -> classify.TextModel:
    """A stand-in model: the share of `e` among the vowels."""
    def model(texts: list[str]) -> list[tuple[str, float]]:
        shares = [t.count("e") / sum(t.count(v) for v in "aeiou") for t in texts]
        return [(schemas.POSITIVE, s) if s >= 0.5 else (schemas.NEGATIVE, 1.0 - s) for s in shares]
    return model


@query
def cross_validate(spark, sf):
    rows = training_posts(spark, sf)
    return classify.cross_validate(rows, word_bayes(rows), ids=["textID"])


@query
def wrong_predictions(spark, sf):
    rows = training_posts(spark, sf)
    predicted = classify.fold_predictions(rows, word_bayes(rows), ids=["textID"])
    return classify.wrong_predictions(predicted).select(
        "textID", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "fold")


@query
def accuracy_test(spark, sf):
    bayes = word_bayes(training_posts(spark, sf))
    return rounded_test(reports.accuracy_report(training(spark, sf), bayes)["test"])


def rounded_test(tested: DataFrame) -> DataFrame:
    return tested.select(*[F.round(c, 6).alias(c) for c in ("mean_accuracy", "sd", "t", "critical")], "n", "reject")


@query
def fold_label_test(spark, sf):
    """The accuracy test on a constant guess: per fold, the share of positive training texts."""
    rows = posts.training_rows(training(spark, sf), ["textID"])
    folds = ranking.assign_folds(rows, ids=["textID"]).groupBy("fold").agg(F.avg("label").alias("accuracy"))
    return rounded_test(hypothesis.accuracy_test(folds))
