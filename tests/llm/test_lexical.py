import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from posttide.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total if total else 0
            score = sum(weight[w] * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    likely = [1 / (i + 1) for i in range(400)]
    docs = [(i, rng.choice([" ", "-", "\n", "_", "\x7f"]).join(rng.choices(words, likely, k=rng.randrange(1, 60))))
            for i in range(n)]
    docs += [(None, docs[0][1]), (None, docs[1][1]), (900, None), (901, ""), (902, " .,- "), (3, docs[3][1]),
             (903, "W1 Ünï w1É " * 30), (904, "w0 " * 30000)]
    docs += [(1000 + i, "the same hot text w5 w6 w399") for i in range(80)]
    items = [(i, " ".join(rng.choices(words, likely, k=rng.randrange(1, 25)))) for i in range(12)]
    items += [(0, "ünï w1é W3"), (50, None), (51, ""), (52, "absent words"), (None, "w7 w7"), (53, "hot w5 w399")]
    return docs, items


@pytest.mark.parametrize("seed,block,short,primed", [(1, 16, 8, 2), (2, 64, 1, 64), (3, 4096, 10**9, 1), (4, 7, 3, 3)])
def test_equals_brute_force(spark, documents, monkeypatch, seed, block, short, primed):
    monkeypatch.setattr(lexical, "PRIMED", primed)
    docs, items = corpus(seed, 300)
    table = documents(docs).withColumns({c: F.lit(1) for c in ("rank", "score", "item_id", "item", "block")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = lexical.rank_documents(table, asked, k=20, block_documents=block, short=short)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 20)


def test_several_slices_of_items(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_BYTES", 300)
    docs, items = corpus(5, 60)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.rank_documents(documents(docs), asked, k=5)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 5)


def test_empty_tables(spark, documents):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    docs = documents([(1, "w1 w2"), (2, "w3")])
    assert lexical.rank_documents(docs.where("doc_id > 5"), asked).count() == 0
    nothing = lexical.rank_documents(docs, asked.where("item_id > 5"))
    assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank_documents(documents([(1, None), (2, "")]), asked).count() == 0


def test_blocks_give_what_all_sums_give():
    """Whatever is short, skipped or to be beaten, the documents at or above the score are found."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 300))
        lists = object.__new__(lexical.Lists)
        lists.size, lists.lists = size, {}
        whole = np.zeros(size, np.int64)
        for t in range(int(rng.integers(0, 9))):
            places = np.flatnonzero(rng.random(size) < rng.choice([0.01, 0.1, 0.9]))
            if not len(places):
                continue
            scores = rng.integers(0, 50, len(places))
            lists.lists[t] = (places, scores, int(scores.max()))
            whole[places] += scores
        beat = int(rng.integers(1, 120))
        places, scores = lexical.best_of_block(lists, np.arange(10), beat)
        assert places.tolist() == np.flatnonzero(whole >= beat).tolist() and (scores == whole[places]).all()


def test_lengths_beyond_64_bits_stay_exact():
    import pyarrow as pa

    lists = lexical.Lists([0], [1], pa.table({"doc_id": pa.array([1]), "n": pa.array([10**12])}),
                          pa.table({"place": pa.array([0], pa.int32()), "tf": pa.array([7])}), np.array([1000]),
                          10**9, 10**15)
    assert lists.lists[0][2] == 1000 * (7 * 10**9 // (7000 + 20 * (50 + 50 * 10**21 // 10**15)))


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, queries.op11_ranked_search, queries.ORACLE["op11_ranked_search"]) is None
