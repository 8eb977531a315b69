from concurrent.futures import ThreadPoolExecutor

import pytest

from posttide.sources import ledger


def batch(spark, name, *months):
    rows = [(f"{m}", f"{name}.csv", i, f"{name} {i}") for m, n in months for i in range(n)]
    return spark.createDataFrame(rows, "year_month string, file string, pos bigint, text string").repartition(3)


def ids(spark, table):
    found = {}
    for r in ledger.read_appended(spark, table).orderBy("year_month", "id").collect():
        found.setdefault(r["year_month"], []).append((r["id"], r["text"]))
    return found


def test_a_job_run_twice_leaves_one_copy(spark, tmp_path):
    table = str(tmp_path / "t")
    assert ledger.append_once(batch(spark, "a", ("2022_03", 3), ("2022_04", 1)), table, "one")
    assert not ledger.append_once(batch(spark, "a", ("2022_03", 3), ("2022_04", 1)), table, "one")
    assert ledger.append_once(batch(spark, "b", ("2022_03", 2), ("2022_05", 1)), table, "two")
    assert ids(spark, table) == {
        "2022_03": [(1, "a 0"), (2, "a 1"), (3, "a 2"), (4, "b 0"), (5, "b 1")],
        "2022_04": [(1, "a 0")], "2022_05": [(1, "b 0")]}
    assert [c.last for c in ledger.commits(spark, table)][-1] == {"2022_03": 5, "2022_04": 1, "2022_05": 1}


def test_interleaved_writers_give_ids_without_gaps(spark, tmp_path):
    table = str(tmp_path / "t")
    first = ledger.stage(batch(spark, "a", ("2022_03", 3)), table)
    second = ledger.stage(batch(spark, "b", ("2022_03", 2)), table)
    assert ledger.commit(spark, table, "b", *second) and ledger.commit(spark, table, "a", *first)
    assert [t for _, t in ids(spark, table)["2022_03"]] == ["b 0", "b 1", "a 0", "a 1", "a 2"]
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(ledger.append_once, batch(spark, f"w{i}", ("2022_03", 2)), table, f"w{i % 3}")
                for i in range(4)]
    assert sum(j.result() for j in jobs) == 3
    assert [n for n, _ in ids(spark, table)["2022_03"]] == list(range(1, 12))


def test_a_taken_number_is_not_overwritten(spark, tmp_path):
    table = str(tmp_path / "t")
    ledger.append_once(batch(spark, "a", ("2022_03", 1)), table, "one")
    files = ledger._Files(spark, table)
    kept = files.read("000000000001.json")
    assert not files.claim("000000000001.json", {"job": "other"})
    assert files.read("000000000001.json") == kept and files.names() == ["000000000001.json"]
    assert not [p for p in (tmp_path / "t" / "log").iterdir() if p.name.endswith(".draft")]


def test_a_killed_write_leaves_nothing_to_see(spark, tmp_path):
    table = str(tmp_path / "t")
    ledger.stage(batch(spark, "dead", ("2022_03", 4)), table)
    with pytest.raises(ValueError):
        ledger.read_appended(spark, table)
    assert ledger.append_once(batch(spark, "a", ("2022_03", 2)), table, "one")
    assert ids(spark, table) == {"2022_03": [(1, "a 0"), (2, "a 1")]}


def test_empty_batches_other_columns_and_rows_without_month(spark, tmp_path):
    table = str(tmp_path / "t")
    assert ledger.append_once(batch(spark, "e"), table, "empty")
    assert ledger.read_appended(spark, table).count() == 0
    assert ledger.append_once(batch(spark, "a", ("2022_03", 1)), table, "one")
    assert ids(spark, table) == {"2022_03": [(1, "a 0")]}
    with pytest.raises(ValueError):
        ledger.append_once(batch(spark, "a", ("2022_03", 1)).drop("text"), table, "fewer")
    with pytest.raises(ValueError):
        ledger.append_once(batch(spark, "a", ("2022_03", 1)).selectExpr("CAST(NULL AS STRING) AS year_month", "file", "pos", "text"), table, "none")


def test_a_month_reads_its_own_folders(spark, tmp_path):
    table = str(tmp_path / "t")
    ledger.append_once(batch(spark, "a", ("2022_03", 3), ("2022_04", 1)), table, "one")
    plan = ledger.read_appended(spark, table).where("year_month = '2022_04'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "year_month" in text.split("PartitionFilters: [")[1].split("]")[0] and plan.count() == 1


def test_whole_job_run_again(spark, tmp_path):
    from test_sources import export, post

    from posttide.plans import preprocess

    (tmp_path / "raw").mkdir()
    export(tmp_path / "raw" / "a.csv", [post("one"), post("two")])
    (tmp_path / "g.csv").write_text(",".join(preprocess.readers.schemas.GAZETTEER_COLUMNS) + "\n")
    for _ in range(2):
        preprocess.run(spark, str(tmp_path / "raw"), str(tmp_path / "g.csv"), str(tmp_path / "out"), job="march")
    rows = ledger.read_appended(spark, str(tmp_path / "out/all")).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "one"), (2, "two")]
    month = preprocess.readers.read_month(spark, str(tmp_path / "out/all"), "2022_03")
    assert sorted(r["id"] for r in month.collect()) == [1, 2]
    with pytest.raises(ValueError):
        preprocess.run(spark, "raw", "g.csv", "out", fmt="csv", job="march")
