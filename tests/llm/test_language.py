import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posttide.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = queries.op9_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.Network({k: v.astype(np.float64) for k, v in language.Network.fresh(3).w.items()})
    data, label = rng.integers(97, 103, (5, 4)), np.array([0, 1, 2, 1, 0])

    def loss():
        runs = [np.asarray(net.run(data, d)[0], np.float64) for d in "fb"]
        p = net.probabilities(np.concatenate(runs, axis=-1))
        return -np.log(p[:, np.arange(5), label]).sum() / data.size

    found = net.gradients(data, label)
    for name, at in (("out", (3, 1)), ("bias", (2,)), ("fx", (98, 5)), ("fh", (2, 40)), ("bx", (99, 30)), ("bh", (1, 3))):
        before = net.w[name][at]
        net.w[name][at] = before + 1e-2
        up = loss()
        net.w[name][at] = before - 1e-2
        down = loss()
        net.w[name][at] = before
        assert found[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_equal_to_running_every_word_alone():
    rng = random.Random(0)
    model = {"languages": ["a", "b", "c"], "weights": language.Network.fresh(3).w}
    net = language.Network(model["weights"])
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 50))) for _ in range(30)).encode()
             for _ in range(8)] + [b""]
    got = language.Labeller(model).pooled(texts)
    for text, row in zip(texts, got):
        total, places = np.zeros(3), 0
        for word in (w[i:i + language.UNIT] for w in text.split() for i in range(0, len(w), language.UNIT)):
            total += net.forward(np.frombuffer(word, np.uint8)[None]).sum(axis=(0, 1))
            places += len(word)
        assert row == pytest.approx(total / max(places, 1), abs=1e-5)


def test_odd_texts_and_nothing_learned(documents):
    rows = [(i, "der und die ist nicht", "de") for i in range(30)] + [(50 + i, "the and of that with", "en") for i in range(30)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 !! ---", "de"), (103, "und die der", None), (None, "the of", "en"),
             (104, "x" * 5000, "en"), (0, "der und die ist nicht", "de")]
    docs = documents(rows).withColumn("c1", F.lit(2))
    model = language.fit(docs, F.lit(True))
    assert model["languages"] == ["de", "en"]
    found = language.identify(docs, model)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "de" and got[None].lang_pred == "en" and got[103].score > 0.5
    none = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.where("doc_id > 900"), model).count() == 0
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("score", F.lit(1)), model)


def test_a_language_of_one_text_in_many_copies_is_learned(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 10_000, "many").otherwise("one").alias("lang"),
        F.when(F.col("id") < 10_000, F.concat(F.lit("text "), F.col("id"))).otherwise("der und die").alias("text"))
    for copies in (rows, rows.withColumn("text", F.when(F.col("lang") == "one", "das ist nicht").otherwise(F.col("text")))):
        hashed = copies.select("lang", F.xxhash64("text").alias("h"))
        found = language.smallest_hashes(hashed, "lang", 50)
        assert {r.lang: r["count"] for r in found.groupBy("lang").count().collect()} == {"many": 50, "one": 1}
    few = spark.range(20_000).select(F.lit("few").alias("lang"), F.xxhash64(F.col("id") % 40).alias("h"))
    assert language.smallest_hashes(few, "lang", 30).count() == 30


def test_a_language_of_long_texts_only_is_learned(documents):
    rows = [(i, f"der und die ist nicht {i} " * 900, "de") for i in range(12)]
    rows += [(50 + i, f"the and of that with {i}", "en") for i in range(12)]
    docs = documents(rows + [(99, None, "fr")]).withColumn("_found", F.lit(2))
    model = language.fit(docs, F.lit(True))
    assert model["languages"] == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r["_found"]) for r in language.identify(docs, model).collect()}
    assert got == {i: ("de", 2) for i in range(12)} | {50 + i: ("en", 2) for i in range(12)} | {99: ("und", 2)}


def test_stretch(spark):
    texts = ["", "short", "x" * 64, "é" * 32, "é" * 33, "abcdefghij" * 50, "日本語 " * 40]
    rows = spark.createDataFrame([(t, h) for t in texts for h in (0, 1, -7, 2 ** 62, -2 ** 63)], "text string, h long")
    found = rows.withColumn("part", language.stretch(F.col("text"), F.col("h"), 64)).collect()
    for r in found:
        if len(r.text.encode()) <= 64:
            assert r.part == r.text
        else:
            start = r.h % (len(r.text) - 16 + 1)
            assert r.part == r.text[start:start + 16] and len(r.part.encode()) <= 64
