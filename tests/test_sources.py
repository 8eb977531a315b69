"""CSV by header name, months of files, numbered sinks, and the whole job."""

import csv

import pytest
from explained import plan_of
from pyspark.sql import functions as F

from posttide import schemas
from posttide.operators import places
from posttide.plans import preprocess
from posttide.session import materialize
from posttide.sources import readers, writers


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


def post(text="hi", created="2022-03-05 10:00:00.5", location="oslo", tags="[{'text': 'a'}]", language="en", n="3"):
    return dict(location=location, tweetcreatedts=created, text=text, hashtags=tags, following="1", followers="5",
                totaltweets=n, retweetcount="2", favorite_count="3", language=language, extra="z")


def export(path, posts, order=None):
    header = order or list(post())
    write_csv(path, header, [[p[h] for h in header] for p in posts])


@pytest.fixture()
def posts_dir(tmp_path):
    folder = tmp_path / "posts"
    folder.mkdir()
    multi = 'two\nlines, "quoted" & more'
    export(folder / "a.csv", [post("junk date", created="junk"), post(multi), post("late", created="2022-04-01 00:00:00"),
                              post("dropped", language="de"), post("no tags", tags="oops")])
    export(folder / "b.csv", [post("b one"), post("b two", location="nowhere")], order=list(reversed(list(post()))))
    export(folder / "c.csv", [post("never", created="junk")])
    return str(folder)


@pytest.fixture()
def gaz_path(tmp_path):
    path = tmp_path / "gaz.csv"
    write_csv(path, list(reversed(schemas.GAZETTEER_COLUMNS)),
              [list(reversed(["Oslo", 59.9, 10.7, "03", "OsloState", 59.0, 10.0, "NA", "Norway", 60.0, 8.0]))])
    return str(path)


def test_columns_are_matched_by_name(spark, posts_dir):
    df = readers.read_posts(spark, posts_dir)
    rows = {r["text"]: r for r in df.collect()}
    assert len(rows) == 8 and all(r["language"] in ("en", "de") for r in rows.values())
    assert 'two\nlines, "quoted" & more' in rows
    assert rows["b one"]["file"].endswith("/b.csv") and rows["b one"]["followers"] == "5"


def test_missing_columns_are_null(spark, tmp_path):
    write_csv(tmp_path / "x.csv", ["a", "b"], [[1, 2]])
    write_csv(tmp_path / "y with blank.csv", ["b", "c"], [[3, 4]])
    df = readers.read_csv_by_header(spark, str(tmp_path), {"a": "int", "b": "int", "c": "int"})
    assert sorted(map(str, (tuple(r) for r in df.select("a", "b", "c").collect()))) == ["(1, 2, None)", "(None, 3, 4)"]


def test_row_order_in_file(spark, tmp_path):
    write_csv(tmp_path / "x.csv", ["a"], [[i] for i in range(5000)])
    df = readers.read_csv_by_header(spark, str(tmp_path), {"a": "int"}, multiline=False)
    assert [r["a"] for r in df.orderBy("pos").collect()] == list(range(5000))


def test_file_month(spark, posts_dir):
    df = readers.assign_file_month(readers.land_posts(readers.read_posts(spark, posts_dir)))
    assert {(r["file"][-5:], r["year_month"]) for r in df.collect()} == {("a.csv", "2022_03"), ("b.csv", "2022_03")}
    assert df.count() == 7


def test_row_file_counts(spark, posts_dir):
    row = readers.row_file_counts(readers.read_posts(spark, posts_dir)).first()
    assert (row["n_rows"], row["n_files"]) == (8, 3)


def test_gazetteer_codes_stay_text(spark, gaz_path):
    row = readers.read_gazetteer(spark, gaz_path).first()
    assert row["country_code"] == "NA" and row["state_code"] == "03" and row["city_latitude"] == 59.9


def test_month_from_file_name(spark):
    df = spark.createDataFrame([("posts_by_country_2022_03.csv",), ("x",)], "f string")
    assert [r[0] for r in df.select(readers.month_from_file_name(F.col("f"))).collect()] == ["2022_03", ""]


def test_whole_job_light(spark, posts_dir, gaz_path, tmp_path):
    out = str(tmp_path / "out")
    preprocess.run(spark, posts_dir, gaz_path, out)
    every = readers.read_preprocessed(spark, f"{out}/all").orderBy("id").collect()
    assert [r["text"] for r in every] == ["junk date", 'two lines, "quoted" & more', "late", "b one", "b two"]
    assert [r["id"] for r in every] == [1, 2, 3, 4, 5]
    assert set(every[0].asDict()) == {*schemas.PREPROCESSED_COLUMNS, "year_month"}
    located = readers.read_month(spark, f"{out}/located", "2022_03").orderBy("id").collect()
    assert [(r["id"], r["text"], r["city"]) for r in located][-1] == (4, "b one", "Oslo")
    assert every[1]["popularity_score"] == 5 and every[1]["reach_score"] == 4 and every[1]["hashtags"] == ["a"]
    preprocess.run(spark, posts_dir, gaz_path, out)
    again = readers.read_preprocessed(spark, f"{out}/all")
    assert sorted(r["id"] for r in again.collect()) == list(range(1, 11))


def test_whole_job_heavy(spark, posts_dir, gaz_path, tmp_path):
    lexicon = spark.createDataFrame([("lines", "n", "line", 2)], "surface string, pos string, lemma string, freq bigint")
    preprocess.run(spark, posts_dir, gaz_path, str(tmp_path / "out"), preprocess.HEAVY, lexicon)
    rows = readers.read_preprocessed(spark, str(tmp_path / "out/all")).orderBy("id").collect()
    assert rows[1]["text"] == ["two", "line", "quoted"] and rows[3]["text"] == ["b", "one"]


def test_csv_sink_serialises_lists(spark, tmp_path):
    df = spark.createDataFrame([("m", "f", 0, ["x", "y"], " t ")],
                               "year_month string, file string, pos bigint, hashtags array<string>, text string")
    writers.write_posts(df, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["hashtags"] == '["x","y"]' and back["text"] == " t " and back["id"] == "1"


def test_labelled_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "2022-03-01", "POSITIVE", 0.9, ["x"], "2022_03")],
                               "id bigint, country string, date string, sentiment string, sentiment_score double, "
                               "hashtags array<string>, year_month string")
    writers.write_labelled(df, str(tmp_path / "l"), fmt="csv")
    back = readers.read_csv_by_header(spark, str(tmp_path / "l"), schemas.LABELLED_TYPES | {"hashtags": "string"},
                                      recursive=True).first()
    assert back["sentiment_score"] == 0.9 and back["country"] == "A" and back["hashtags"] == '["x"]'
    assert readers.read_labelled(spark, str(tmp_path / "l") + "/year_month=2022_03", "csv").first()["hashtags"] == ["x"]


def test_country_folders(spark, tmp_path):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "A").when(F.col("id") < 290, "B").alias("country"),
                                 F.lit("2022_03").alias("year_month"))
    writers.write_by_country(df, str(tmp_path / "c"))
    back = readers.read_labelled(spark, str(tmp_path / "c")).groupBy("country").count().collect()
    assert {r["country"]: r["count"] for r in back} == {"A": 200, "B": 90}


def test_one_month_reads_one_folder(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("2022_0"), F.col("id") % 3 + 1).alias("year_month"))
    writers.write_labelled(df, str(tmp_path / "m"))
    month = readers.read_month(spark, str(tmp_path / "m"), "2022_02")
    assert month.count() == 3 and "PartitionFilters: [isnotnull(year_month" in plan_of(month)


def test_preprocessing_stays_in_the_jvm(spark, posts_dir, gaz_path):
    raw = readers.land_posts(readers.read_posts(spark, posts_dir))
    index = materialize(places.build_place_index(readers.read_gazetteer(spark, gaz_path)), "index")
    for mode in (preprocess.LIGHT, preprocess.HEAVY):
        plan = plan_of(preprocess.preprocess(raw, index, mode))
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
        assert "BroadcastHashJoin" in plan and "EqualTo(language,en)" in plan


def test_many_headers_wide_files_and_empty_files(spark, tmp_path):
    for i in range(1100):
        write_csv(tmp_path / f"f{i}.csv", [f"x{i}", "a", "b"] if i % 2 else ["b", f"x{i}", "a"], [[i, i, i]])
    (tmp_path / "empty.csv").write_text("")
    write_csv(tmp_path / "bare.csv", ["a", "b"], [])
    write_csv(tmp_path / "wide.csv", [f"w{i}" for i in range(200)] + ["a", "b", "a"], [[*range(200), 5000, 6, 7]])
    with open(tmp_path / "bom.csv", "w", encoding="utf-8-sig") as f:
        f.write("a,b\n9000,1\n")
    df = readers.read_csv_by_header(spark, str(tmp_path), {"a": "int", "b": "int", "w199": "int"})
    rows = {r["a"]: r for r in df.collect()}
    assert set(rows) == {*range(1100), 5000, 9000} and df.count() == 1102
    assert rows[5000]["w199"] == 199 and rows[5000]["b"] == 6 and rows[7]["b"] in (7,) and rows[7]["w199"] is None
    assert readers.read_csv_by_header(spark, str(tmp_path), ["a", "nowhere"], only_present=True).columns == ["a", "file", "pos"]


def test_no_rows_at_all_are_an_error(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.read_csv_by_header(spark, str(tmp_path), ["a"])


def test_gazetteer_rows_are_numbered_by_file_and_place(spark, tmp_path):
    folder = tmp_path / "gaz"
    folder.mkdir()
    def line(n):
        return [f"City{n}", 1.0, 2.0, "S", "State", 1.0, 2.0, "C", "Country", 1.0, 2.0]
    write_csv(folder / "part-0.csv", schemas.GAZETTEER_COLUMNS, [line(1)])
    write_csv(folder / "part-1.csv", schemas.GAZETTEER_COLUMNS, [line(n) for n in range(2, 400)])
    found = readers.read_gazetteer(spark, str(folder)).collect()
    assert all(r["city_name"] == f"City{r['row_id']}" for r in found) and len(found) == 399


def numbered(spark, months):
    rows = [(m, "f", i, f"t{i}") for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "year_month string, file string, pos bigint, text string")


def test_appends_need_ids_and_read_their_own_months(spark, tmp_path):
    path = str(tmp_path / "posts")
    assert writers.last_ids(numbered(spark, ["2022_03"]), path) is None
    numbered(spark, ["2022_03"]).write.partitionBy("year_month").parquet(path)
    with pytest.raises(ValueError, match="no ids"):
        writers.write_posts(numbered(spark, ["2022_03"]), path)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        writers.write_posts(numbered(spark, ["2022_03"]), str(broken))
    good = str(tmp_path / "good")
    writers.write_posts(numbered(spark, ["2022_03", "2022_04", "2022_04"]), good)
    last = {r["year_month"]: r["last_id"] for r in writers.last_ids(numbered(spark, ["2022_04"]), good).collect()}
    assert last == {"2022_04": 2}
    stored = spark.read.parquet(good).where(F.col("year_month").cast("string").isin(["2022_04"]))
    assert "= 2022_04)], PushedFilters: []" in plan_of(stored)


def test_labelled_months_have_few_files(spark, tmp_path):
    df = spark.range(4000).select("id", F.concat(F.lit("2022_0"), F.col("id") % 8 + 1).alias("year_month")).repartition(16)
    writers.write_labelled(df, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").rglob("*.parquet"))) <= 16


def scratch_tables(spark):
    import os
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/posttide"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_intermediate_tables_end_with_the_job(spark, posts_dir, gaz_path, tmp_path):
    before = scratch_tables(spark)
    lexicon = spark.createDataFrame([("lines", "n", "line", 2)], "surface string, pos string, lemma string, freq bigint")
    preprocess.run(spark, posts_dir, gaz_path, str(tmp_path / "out"), preprocess.HEAVY, lexicon)
    assert scratch_tables(spark) == before
    with pytest.raises(Exception):
        preprocess.run(spark, posts_dir, str(tmp_path / "nowhere"), str(tmp_path / "other"))
    assert scratch_tables(spark) == before


def test_headers_are_found_without_sorting_the_rows(spark, tmp_path, monkeypatch):
    plans, plain = [], readers.materialize
    monkeypatch.setattr(readers, "materialize", lambda df, label: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, label))[1])
    for name, body in (("a", "x,y\n1,2\n3,4\n"), ("b", "y,x\n5,6\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    found = readers.read_csv_by_header(spark, str(tmp_path), ["x", "y"])
    assert sorted((r.x, r.y) for r in found.collect()) == [("1", "2"), ("3", "4"), ("6", "5")]
    assert not any("SortAggregate" in p or "Sort [" in p for p in plans)
