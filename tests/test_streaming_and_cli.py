import runpy
import sys

import pytest
from pyspark.sql import functions as F
from test_sources import export, post, write_csv

from posttide.functions import text
from posttide.plans import queries
from posttide.streaming import posts as stream_posts


def test_stream_equals_batch_and_takes_each_post_once(spark, sf_dir, tmp_path):
    raw = queries.raw_posts(spark, sf_dir)
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    raw.where("row_key < 100").write.parquet(landing)

    def run():
        stream = spark.readStream.schema(raw.schema).parquet(landing)
        stream_posts.append_clean_posts(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)

    run()
    raw.where("row_key >= 100").write.mode("append").parquet(landing)
    run()
    run()
    found = spark.read.parquet(out)
    batch = stream_posts.clean_posts(raw)
    columns = ["row_key", "year_month", "text", "reach_score", "popularity_score"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(found) == key(batch) and found.count() > 0


def test_stream_cleans_like_the_batch_job(spark, sf_dir):
    raw = queries.raw_posts(spark, sf_dir)
    both = stream_posts.clean_posts(raw).select("row_key", "text").join(
        raw.select("row_key", text.clean_light(F.col("text")).alias("t")), "row_key")
    assert both.where("text <> t").count() == 0


def test_sentiment_command(spark, sf_dir, tmp_path, monkeypatch):
    labelled = str(tmp_path / "labelled")
    queries.labelled_posts(spark, sf_dir).write.partitionBy("year_month").parquet(labelled)
    monkeypatch.setattr(sys, "argv", ["posttide", "sentiment", "--labelled", labelled, "--out", str(tmp_path / "r")])
    runpy.run_module("posttide", run_name="__main__")
    assert spark.read.parquet(str(tmp_path / "r" / "bias_test")).count() == 20
    assert spark.read.parquet(str(tmp_path / "r" / "rejected_ratio")).count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_all_jobs_one_after_the_other(spark, tmp_path, monkeypatch, fmt):
    def run(*words):
        monkeypatch.setattr(sys, "argv", ["posttide", *map(str, words)])
        runpy.run_module("posttide", run_name="__main__")

    places, states, raw = tmp_path / "places.csv", tmp_path / "states.csv", tmp_path / "raw"
    write_csv(places, ["city_name", "city_latitude", "city_longitude", "state_name", "country_name"],
              [["Oslo", 59.9, 10.7, "OsloState", "Norway"], ["Bergen", 60.4, 5.3, "Vestland", "Norway"]])
    write_csv(states, ["country_name", "state_name", "state_code", "state_latitude", "state_longitude", "country_code",
                       "country_latitude", "country_longitude"],
              [["Norway", "OsloState", "03", 59.0, 10.0, "NO", 60.0, 8.0], ["Norway", "Vestland", "46", 60.0, 6.0, "NO", 60.0, 8.0]])
    raw.mkdir()
    words = ["great", "good", "awful", "bad"]
    export(raw / "a.csv", [post(f"{words[i % 4]} day number x{i} again", location=["oslo", "bergen"][i % 2],
                                created=f"2022-03-{i % 28 + 1:02d} 10:00:00") for i in range(60)])
    write_csv(tmp_path / "training.csv", ["textID", "text", "selected_text", "sentiment"],
              [[i, f"{words[i % 4]} thing {i}", "", ["positive", "positive", "negative", "negative"][i % 4]] for i in range(80)])
    run("gazetteer", "--places", places, "--states", states, "--out", tmp_path / "gaz")
    run("preprocess", "--posts", raw, "--gazetteer", tmp_path / "gaz", "--out", tmp_path / "posts", "--format", fmt)
    run("train", "--training", tmp_path / "training.csv", "--out", tmp_path / "model")
    located = tmp_path / "posts" / "located"
    run("label", "--posts", located, "--model", tmp_path / "model", "--out", tmp_path / "labelled", "--format", fmt)
    run("label", "--posts", located, "--model", "posttide.plans.queries:vowel_model", "--out", tmp_path / "other",
        "--format", fmt)
    run("sentiment", "--labelled", tmp_path / "labelled", "--out", tmp_path / "report", "--format", fmt,
        "--start", "2022-03-01", "--end", "2022-03-31")
    run("topics", "--posts", tmp_path / "posts" / "all", "--month", "2022_03", "--out", tmp_path / "topics", "--format", fmt)
    run("accuracy", "--training", tmp_path / "training.csv", "--out", tmp_path / "accuracy")

    def table(name):
        return spark.read.parquet(str(tmp_path / name))

    counts = table("report/sentiment_counts").collect()
    assert [(r["country"], r["Negative"], r["Positive"]) for r in counts] == [("Norway", 30, 30)]
    assert table("topics/topic_shares").count() == 10 and table("topics/top_ngrams").count() == 10
    assert table("topics/documents").count() == 60
    assert table("accuracy/folds").count() == 5 and table("accuracy/wrong_predictions").count() == 0
