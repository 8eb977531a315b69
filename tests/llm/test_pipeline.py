import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_simhash import plain_fingerprint, plain_groups
from test_substring import brute

from posttide.llm import bpe, decontaminate


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What every stage gave on the smallest tables, as the driver of the pipeline writes it."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {"documents": docs.collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found[name] = docs.collect()
    return found


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_order_and_columns(stages):
    assert list(stages) == ["documents", "language", "near-duplicates", "repeated-passages", "benchmark", "tokens"]
    for name in list(stages)[:-1]:
        assert list(stages[name][0].asDict()) == pipeline.COLUMNS


def test_language_keeps_prose(stages):
    before, after = texts(stages["documents"]), texts(stages["language"])
    assert len(after) > 0.97 * len(before) and all(before[i] == t for i, t in after.items())


def test_near_duplicates_equal_brute_force(stages):
    rows = sorted(stages["language"], key=lambda r: r.doc_id)
    groups = plain_groups([plain_fingerprint(r.text) for r in rows])
    first = {rows[g].doc_id for g in groups}
    assert {r.doc_id for r in stages["near-duplicates"]} == first
    assert len(stages["near-duplicates"]) == len(first)


def test_repeated_passages_equal_brute_force(stages):
    before, after = texts(stages["near-duplicates"]), texts(stages["repeated-passages"])
    assert before.keys() == after.keys()
    for (i, t), (_, removed, kept) in zip(before.items(), brute(before.values(), 35)):
        assert after[i] == (kept if removed else t)


def test_no_benchmark_text_is_left_and_nothing_else_went(stages, spark, sf_dir):
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts(stages["repeated-passages"]), texts(stages["benchmark"])
    index = decontaminate.Index.build(list(range(len(items))), items)
    for i, t in before.items():
        held = decontaminate.normalised(t or "")
        exact = any(item in held for item in items)
        assert not exact or i not in after
        if i not in after and not exact:
            assert list(decontaminate.matches(index, [held]))


def test_tokens_equal_the_library(stages):
    whole = bpe.encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    before = texts(stages["benchmark"])
    assert len(stages["tokens"]) == len(before)
    for r in stages["tokens"]:
        assert r.ids == whole.encode_ordinary(before[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_run_gives_the_same(stages, spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.n_tokens) for r in stages["tokens"])


def test_empty_and_odd_documents_go_through(spark, sf_dir, documents):
    rows = [(None, "the of and that prose"), (1, None), (2, ""), (3, "12 34"), (4, "the of and"), (4, "the of and"),
            (5, "der die das und nicht", None)]
    for docs in (documents(rows).withColumn("extra", F.lit(1)), documents(rows).where("doc_id > 99")):
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name == "language":
                kept = {r.doc_id for r in docs.collect()}
                assert kept in (set(), {None, 4, 5})
        docs.count()


def test_no_text_travels_with_its_tokens(spark, documents, sf_dir):
    rows = [(1, "a  b\n"), (2, None), (3, ""), (None, "é 😀"), (1, "a  b\n")]
    coded = pipeline.tokens(spark, documents(rows), sf_dir)
    assert "text" not in spark.read.parquet(*coded.inputFiles()).columns
    assert all(r.round_trip for r in coded.collect()) and coded.count() == len(rows)
