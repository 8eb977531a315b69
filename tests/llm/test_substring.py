import hashlib
import random
from collections import Counter

import pytest
from compare import compare
from pyspark.sql import functions as F

from posttide.llm import queries, substring


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def rows_of(df):
    return sorted(df.select("doc_id", "n_words", "n_removed", "kept").collect(), key=str)


@pytest.mark.parametrize("window", [2, 5])
def test_equals_brute_force(documents, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("a b c d e f g é".split()) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [None, "", " \n\t", texts[3], texts[3], "x" * 5000, "a " * 3000, "one two three\x1cfour five six seven"]
    rows = list(enumerate(texts)) + [(None, texts[5]), (7, texts[7])]
    got = rows_of(substring.remove_repeats(documents(rows), window=window))
    expected = brute([t for _, t in rows], window)
    assert got == sorted([(r[0], *e) for r, e in zip(rows, expected)], key=str)


def test_intervals_are_maximal(documents):
    rows = [(1, "p a b c d q"), (2, "r a b c d s"), (3, "a b x")]
    found = {r.doc_id: [(x.start, x.end) for x in r.removed]
             for r in substring.remove_repeats(documents(rows), window=3).collect()}
    assert found == {1: [(1, 5)], 2: [(1, 5)], 3: []}


def test_long_texts_are_cut_without_change(documents, monkeypatch):
    from posttide.llm import blocks
    text = " ".join(str(i) for i in range(5000))
    assert b"".join(blocks.pieces(text.encode(), 100)) == text.encode()
    joined = [w for p in blocks.pieces(text.encode(), 100) for w in p.split()]
    assert joined == text.encode().split()


def test_empty_table_and_clashing_names(documents, spark):
    empty = documents([(1, "a")]).where("doc_id < 0")
    assert substring.remove_repeats(empty).count() == 0
    extra = documents([(1, "a b"), (2, "a b")]).withColumns(
        {c: F.lit(9) for c in ("block", "payload", "part", "c0", "answer")})
    found = substring.remove_repeats(extra, window=2)
    assert found.where("block = 9 and part = 9 and c0 = 9 and n_removed = 2").count() == 2
    with pytest.raises(ValueError):
        substring.remove_repeats(extra.withColumn("kept", F.lit(1)))


def test_registered_query_equals_sql(spark, sf_dir):
    name = "op1_substring_dedup"
    assert compare(spark, sf_dir, queries.REGISTRY[name], queries.ORACLE[name]) is None


def test_digest_of_nothing(spark, documents):
    found = substring.remove_repeats(documents([(1, None)])).select(F.sha2("kept", 256)).first()[0]
    assert found == hashlib.sha256(b"").hexdigest()
