import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posttide.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality_of = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op3_quality_by_compression(spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tried = [r for r in rows if r.held_out and r.doc_id in quality_of]
    assert np.mean([r.predicted == quality_of[r.doc_id] for r in tried]) > 0.95
    bad = [r for r in tried if quality_of[r.doc_id] == 0]
    assert np.mean([r.predicted == 0 for r in bad]) > 0.8


def test_equals_plain_compression():
    import zstandard
    good, bad = b"the cat sat on the mat " * 400, b"##@@!!$$%% 0101 " * 400
    compression = quality.Compression(good, bad)
    text = (b"the cat sat !! " * 200)[:1500]
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad)]
    sizes = [sum(len(c.compress(text[i:i + 512])) for i in range(0, 1500, 512)) for c in pair]
    assert compression(text) == pytest.approx(((sizes[0] - sizes[1]) / 1500, np.log(sizes[0] / 1500)), abs=0.02)
    assert compression(b"") == (0.0, 0.0)


def test_odd_labels_and_texts(documents, spark):
    rows = [(i, f"good plain words number {i} and more of them") for i in range(40)]
    rows += [(100 + i, f"$$%% ## {i} || @@ !! ~~ ^^ &&") for i in range(40)]
    rows += [(None, None), (200, ""), (201, None), (202, "word " * 20000), (3, "good again")]
    docs = documents(rows).withColumn("c0", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] +
                                   [(7, None), (None, 1), (8, 5), (3, 1), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    found = quality.score(docs, model)
    assert found.count() == len(rows) and found.where("score is null or score < 0 or score > 1").count() == 0
    means = {r.bad: r.m for r in found.where("doc_id < 140").groupBy((F.col("doc_id") >= 100).alias("bad")).agg(
        F.avg("score").alias("m")).collect()}
    assert means[False] > 0.8 and means[True] < 0.2
    only_good = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {r.score for r in quality.score(docs, only_good).collect()} == {1.0}
    nothing = quality.fit(docs, labels.where("quality > 9"), F.lit(True))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("doc_id > 5000"), model).count() == 0
    with pytest.raises(ValueError):
        quality.score(docs.withColumn("score", F.lit(1)), model)


def test_a_class_of_long_texts_only_is_learned(documents, spark):
    rows = [(i, f"good plain words number {i} and more of them") for i in range(40)]
    rows += [(100 + i, f"$$%% ## {i} || @@ !! ~~ ^^ && " * 2500) for i in range(6)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(documents(rows), labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(documents(rows), model).collect()}
    assert min(got[i] for i in range(40)) > 0.5 > max(got[100 + i] for i in range(6))
