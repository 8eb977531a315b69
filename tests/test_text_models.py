"""Terms, lemmas, topics and classifiers on small texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from posttide.operators import classify, lemmas, posts, sentiment, terms
from posttide.plans import reports


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "row_key int, text string")


def test_bag_tokens(spark):
    df = terms.topic_words(texts(spark, "ab abc ABC a1b"))
    assert {r["term"]: r["term_freq"] for r in terms.term_stats(df).collect()} == {"abc": 2, "a1b": 1}


def test_ngrams(spark):
    df = texts(spark, "the the the", "", None, "one", "a b cd ef", "x")
    assert {r["ngram"]: r["n"] for r in terms.ngram_counts(df).collect()} == {"the the": 2, "cd ef": 1}
    assert terms.ngram_counts(df, 4).count() == 0


def test_ngrams_of_token_lists(spark):
    df = texts(spark, "war go quickly").select("row_key", F.split("text", " ").alias("text"))
    assert {r["ngram"] for r in terms.top_ngrams(df).collect()} == {"war go", "go quickly"}


def test_document_frequency(spark):
    df = terms.topic_words(texts(spark, "aaa aaa bbb", "aaa", "ccc"))
    stats = {r["term"]: (r["term_freq"], r["doc_freq"]) for r in terms.term_stats(df).collect()}
    assert stats == {"aaa": (3, 2), "bbb": (1, 1), "ccc": (1, 1)}
    assert terms.term_list(terms.vocabulary(df, min_df=1, max_terms=2)) == ["aaa", "bbb"]


def test_counts_of_lists_with_nulls(spark):
    lists = [(["b", "a", "b", None, None],), ([],), (None,), (["a"],), (["a"],)]
    df = spark.createDataFrame(lists, "tokens array<string>")
    stats = {r["term"]: (r["term_freq"], r["doc_freq"]) for r in terms.term_stats(df).collect()}
    assert stats == {"a": (3, 3), "b": (2, 1), None: (2, 1)}


def test_term_counts_make_nothing_for_each_word(spark):
    plan = terms.term_stats(terms.topic_words(texts(spark, "aaa bbb")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("sort_array") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_are_made_in_compiled_code(spark, n):
    df = texts(spark, "ab cd ab cd ab", "ab", "", None, "x y", "cd  ab\ncd")
    lists = [["ab", "cd", "ab", "cd", "ab"], ["ab"], [], [], [], ["cd", "ab", "cd"]]
    expected = Counter(" ".join(words[i:i + n]) for words in lists for i in range(len(words) - n + 1))
    for found in (terms.ngram_counts(df, n), terms.ngram_rows(df, n).groupBy("ngram").agg(F.count("*").alias("n"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("regexp_extract_all") == 1
        assert {r["ngram"]: r["n"] for r in found.collect()} == expected
    best = sorted(expected.items(), key=lambda e: (-e[1], e[0]))[:2]
    assert [(r["ngram"], r["n"]) for r in terms.top_ngrams(df, n, 2).collect()] == best


def test_report_counts_ngrams_of_the_written_table(spark, monkeypatch):
    df = texts(spark, *(["apple banana cherry apple"] * 10 + ["dog eagle falcon dog"] * 10)).repartition("row_key")
    seen, top_ngrams = [], terms.top_ngrams
    monkeypatch.setattr(terms, "top_ngrams", lambda given, *rest: seen.append(given) or top_ngrams(given, *rest))
    found = reports.topic_report(df, k=2, passes=1)["top_ngrams"]
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in top_ngrams(df).collect()]
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


LEXICON = [("wars", "n", "war", 10), ("war", "n", "war", 50), ("went", "v", "go", 9), ("go", "v", "go", 40),
           ("better", "a", "good", 5), ("make", "v", "make", 7), ("city", "n", "city", 3), ("man", "n", "man", 9)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "surface string, pos string, lemma string, freq bigint")


@pytest.mark.parametrize("given,expected", [
    ("wars went quickly", "war go quickly"), ("better men making cities", "good man make city"),
    ("makes made goes going", "make made go go"), ("", ""),
])
def test_lemmas(spark, given, expected):
    cleaned = lemmas.clean_heavy(texts(spark, given), lexicon(spark), stopwords=[])
    assert cleaned.first()["text"] == expected.split()


def test_lemmas_keep_rows_and_columns(spark):
    df = texts(spark, "wars", "", "the of").withColumn("other", F.lit(1))
    out = lemmas.clean_heavy(df, lexicon(spark))
    assert {r["row_key"]: (r["text"], r["other"]) for r in out.collect()} == {
        0: (["war"], 1), 1: ([], 1), 2: ([], 1)}
    assert lemmas.clean_heavy(df, None).orderBy("row_key").first()["text"] == ["wars"]


def test_most_frequent_class_wins(spark):
    rows = spark.createDataFrame([("run", "n", "run", 3), ("run", "v", "run", 8), ("cut", "v", "cut", 1)],
                                 "surface string, pos string, lemma string, freq bigint")
    assert {r["token"]: r["pos"] for r in lemmas.tag_tokens(rows).collect()} == {"run": "v", "cut": "v"}


def test_topics_are_repeatable(spark):
    df = texts(spark, *(["apple banana cherry apple"] * 10 + ["dog eagle falcon dog"] * 10))
    first = reports.topic_report(df, k=2, top=2, passes=3)
    again = reports.topic_report(df, k=2, top=2, passes=3)
    key = lambda d: sorted(map(tuple, d["topic_terms"].collect()))
    assert key(first) == key(again)
    shares = first["documents"].select(F.aggregate("topics", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert shares.where("abs(s - 1) > 1e-9").count() == 0
    assert abs(sum(r["share"] for r in first["topic_shares"].collect()) - 1) < 1e-9
    weights = first["term_relevance"]
    assert weights.count() == 2 * 6


def test_python_model_failures_stay_empty(spark):
    def make():
        def model(batch):
            if any("bad" in t for t in batch):
                raise RuntimeError("no")
            return [("POSITIVE", 0.5 + len(t) / 1000) for t in batch]
        return model

    df = texts(spark, "fine", "bad one", None, "also fine", "good")
    rows = {r["row_key"]: (r["sentiment"], r["sentiment_score"])
            for r in classify.score_sentiment(df, make, batch_size=3).collect()}
    assert rows[1] == (None, None) and rows[2] == (None, None)
    assert rows[0] == ("POSITIVE", 0.504) and rows[3][0] == "POSITIVE" and rows[4] == ("POSITIVE", 0.504)


def test_a_broken_model_stops_the_job(spark):
    def make():
        def model(batch):
            raise RuntimeError("broken")
        return model

    df = texts(spark, *[f"text {i}" for i in range(200)]).coalesce(1)
    with pytest.raises(Exception, match="failed on all 200 texts"):
        classify.score_sentiment(df, make).collect()


def test_failures_are_counted(spark):
    rows = [("a", "POSITIVE"), ("b", None), (None, None)]
    assert classify.failed_texts(spark.createDataFrame(rows, "text string, sentiment string")).first()[0] == 1


def test_heavy_text_is_cleaned_once(spark, sf_dir):
    from explained import plan_of
    from posttide.plans import queries
    cleaned = lemmas.clean_heavy(queries.english(spark, sf_dir).select("row_key", "text"), queries.lexicon(spark, sf_dir))
    assert plan_of(cleaned).count("regexp_replace") <= 7


def training(spark):
    good, bad = "good great fine", "awful bad poor"
    return spark.createDataFrame(
        [(i, f"{good if i % 2 else bad} w{i % 3}", i % 2) for i in range(40)], "id int, text string, label int")


def test_classifier(spark):
    model = classify.train_classifier(training(spark))
    scored = classify.score_with_classifier(texts(spark, "great fine", "awful", None), model)
    rows = {r["row_key"]: r for r in scored.collect()}
    assert rows[0]["sentiment"] == "POSITIVE" and rows[1]["sentiment"] == "NEGATIVE"
    assert rows[2]["sentiment"] is None and rows[2]["sentiment_score"] is None and rows[2]["text"] is None
    assert all(0.5 <= rows[i]["sentiment_score"] <= 1 for i in (0, 1))
    predictions = model.transform(training(spark).withColumn("label", F.col("label").cast("double")))
    assert classify.accuracy(predictions).first()[0] == 1.0
    assert classify.wrong_predictions(predictions).count() == 0


def test_cross_validation(spark):
    folds = classify.cross_validate(training(spark), k=4)
    assert sorted(r["fold"] for r in folds.collect()) == [1, 2, 3, 4]
    assert classify.mean_accuracy(folds).first()[0] == 1.0


def test_labelling_samples_months(spark):
    df = training(spark).withColumn("year_month", F.when(F.col("id") < 30, "a").otherwise("b"))
    model = classify.train_classifier(training(spark))
    out = reports.label_posts(df, model, n=12)
    assert Counter(r["year_month"] for r in out.collect()) == {"a": 12, "b": 10}


def monthly(spark):
    rows = [("A", "2022-03-05", "POSITIVE", 0.9), ("A", "2022-03-31", "NEGATIVE", 0.7), ("A", "2022-04-01", None, None),
            ("B", "2022-03-05", "POSITIVE", 0.8), ("B", "2022-02-28", "POSITIVE", 0.8), ("C", "2022-03-01", None, None),
            (None, "2022-03-01", "POSITIVE", 0.6), ("B", "2023-04-30 23:59:59", "NEGATIVE", None)]
    return spark.createDataFrame(rows, "country string, date string, sentiment string, sentiment_score double")


def test_counts(spark):
    found = {(r["country"], str(r["month"])): (r["Negative"], r["Positive"])
             for r in sentiment.sentiment_counts(monthly(spark)).collect()}
    assert found == {("A", "2022-03-01"): (1, 1), ("B", "2022-03-01"): (0, 1), ("B", "2023-04-01"): (1, 0)}


def test_means(spark):
    found = {(r["country"], str(r["month"])): (r["Negative"], r["Positive"])
             for r in sentiment.sentiment_means(monthly(spark)).collect()}
    assert found == {("A", "2022-03-01"): (0.7, 0.9), ("B", "2022-03-01"): (0.0, 0.8), ("B", "2023-04-01"): (0.0, 0.0)}


def test_rankings_differ_by_what_they_count(spark):
    rows = {r["country"]: r["n_posts"] for r in sentiment.top_countries(monthly(spark)).collect()}
    labelled = {r["country"]: r["n_posts"] for r in sentiment.top_countries_labelled(monthly(spark)).collect()}
    assert rows == {"A": 3, "B": 3, "C": 1} and labelled == {"A": 2, "B": 3}


def test_union_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    c = spark.createDataFrame([(3,)], "a int")
    assert sorted(map(tuple, posts.union_all([a, b, c]).collect())) == [(1, "x"), (2, "y"), (3, None)]


def test_report_bundle(spark):
    tables = reports.sentiment_reports(monthly(spark))
    assert {n: t.count() for n, t in tables.items()} == {
        "sentiment_counts": 3, "sentiment_means": 3, "bias_test": 3, "rejected_ratio": 1}


def test_top_ngrams_shuffle_only_candidates(spark):
    words = [f"w{i % 37} w{i % 41} often seen" if i % 2 else "often seen w1" for i in range(400)]
    df = texts(spark, words)
    expected = terms.ngram_counts(df).orderBy(F.desc("n"), "ngram").limit(3).collect()
    assert terms.top_ngrams(df, k=3).collect() == expected
    # A summary too small to prove the third place: a larger one, then all n-grams.
    assert terms.top_ngrams(df, k=3, tracked=(8, 1 << 14)).collect() == expected
    assert terms.top_ngrams(df, k=3, tracked=(8,)).collect() == expected
    assert terms.top_ngrams(df, k=5000).count() == terms.ngram_counts(df).count()
    assert terms.top_ngrams(df.where("row_key < 0")).count() == 0


def test_frequent_values_and_their_bound(spark):
    values = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN 'hot' ELSE concat('v', id) END AS v").repartition(5)
    found, bound = terms.frequent(values, "v", 64)
    names = {r["v"] for r in found.collect()}
    assert "hot" in names and bound == 3.5 * 4000 / 64
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a written table of summaries, not of values
    with pytest.raises(ValueError):
        terms.frequent(values, "v", 0)


def test_a_task_counts_the_ngrams_of_a_bounded_text(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"one two three{i % 7}") for i in range(400)], "id long, text string").coalesce(1)
    monkeypatch.setattr(terms, "PIECE_BYTES", 256, raising=False)
    found = terms.ngram_counts(df, 3)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in found.collect()) == 400 and found.count() == 7


def test_term_stats_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["b", None, None],), ([],), (None,)], "tokens array<string>")
    found = {r["term"]: (r["term_freq"], r["doc_freq"]) for r in terms.term_stats(df).collect()}
    assert found == {"a": (1, 1), "b": (3, 2), None: (2, 1)}
    assert "array_distinct" not in terms.term_stats(df)._jdf.queryExecution().optimizedPlan().toString()
