from collections import Counter

from explained import plan_of
from pyspark.sql import functions as F

from posttide.operators import ranking


def test_fold_sizes(spark):
    df = spark.range(13)
    folds = ranking.assign_folds(df, 5)
    sizes = Counter(r["fold"] for r in folds.collect())
    assert [sizes[i] for i in range(1, 6)] == [3, 3, 3, 2, 2]
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, ranking.assign_folds(df, 5).collect()))
    assert sorted(map(tuple, folds.collect())) != sorted(map(tuple, ranking.assign_folds(df, 5, seed=1).collect()))


def test_fewer_rows_than_folds(spark):
    assert sorted(r["fold"] for r in ranking.assign_folds(spark.range(3), 5).collect()) == [1, 2, 3]


def test_ids_have_no_gaps_and_follow_file_order(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.col("id").alias("pos"),
        F.when(F.col("id") % 3 < 2, "2022_03").otherwise("2022_04").alias("year_month"))
    rows = ranking.assign_ids(df, block_rows=10).collect()
    for month in ("2022_03", "2022_04"):
        ordered = sorted((r["file"], r["pos"], r["id"]) for r in rows if r["year_month"] == month)
        assert [r[2] for r in ordered] == list(range(1, len(ordered) + 1))


def test_ids_go_on(spark):
    df = spark.createDataFrame([("a", 0, "m"), ("a", 1, "n")], "file string, pos bigint, year_month string")
    start = spark.createDataFrame([("m", 41)], "year_month string, last_id bigint")
    assert {r["year_month"]: r["id"] for r in ranking.assign_ids(df, start=start).collect()} == {"m": 42, "n": 1}


def test_sample_is_exact_per_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4010, "small")
                                  .alias("year_month"))
    picked = ranking.sample_exact(df, 700)
    assert {r["year_month"]: r["count"] for r in picked.groupBy("year_month").count().collect()} == {
        "big": 700, "small": 10, None: 700}
    assert picked.select("id").distinct().count() == 1410
    assert set(map(tuple, picked.collect())) == set(map(tuple, ranking.sample_exact(df, 700).collect()))


def test_sample_equals_one_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("string").alias("year_month"))
    picked = {r["id"] for r in ranking.sample_exact(df, 123, seed=9).collect()}
    keyed = df.withColumn("k", ranking.shuffle_key(["id"], 9))
    expected = {r["id"] for half in ("0", "1")
                for r in keyed.where(F.col("year_month") == half).orderBy("k").limit(123).collect()}
    assert picked == expected


def test_rows_are_shuffled_once(spark):
    df = spark.range(100).select(F.concat(F.lit("f"), F.col("id")).alias("file"), F.col("id").alias("pos"),
                                 (F.col("id") % 2).cast("string").alias("year_month"))
    plan = plan_of(ranking.assign_ids(df))
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_large_offsets_are_shuffled_with_salt(spark, monkeypatch):
    from posttide.operators import joins

    plain = joins.lookup_join
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "m").alias("year_month"), F.lit("f").alias("file"),
                                 F.col("id").alias("pos"))
    small = ranking.assign_ids(df.drop("id"), block_rows=16)
    monkeypatch.setattr(ranking, "lookup_join", lambda *a, **k: plain(*a, **{**k, "max_bytes": -1, "salts": 4}))
    large = ranking.assign_ids(df.drop("id"), block_rows=16)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
