import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from posttide.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WHOLE = bpe.encoding(RANKS, public_tokenizers.PATTERN)


def odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n\t .,'s12ß漢  😀") for _ in range(rng.randrange(80))) for _ in range(80)]
    return texts + [None, "", " ", "don't  stop   ", "<|endoftext|> x", "\n\n\n a", "long" * 4000, "é" * 3000, texts[0]]


def test_ids_equal_the_library_and_decode_to_the_text(documents):
    rows = list(enumerate(odd_texts()))
    coded = bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN)
    for r in bpe.decode(coded, RANKS).collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == WHOLE.encode_ordinary(text)
        assert r.decoded == text.encode()


def test_no_rows_null_ids_and_clashing_names(documents):
    docs = documents([(1, "a b"), (None, None)]).withColumns({c: F.lit(3) for c in ("block", "n", "code", "c1", "bytes")})
    found = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    assert found.where("block = 3 and n = 3 and bytes = 3").count() == 2
    assert found.where("doc_id is null").first().ids == []
    assert bpe.encode(docs.where("doc_id < 0"), RANKS, public_tokenizers.PATTERN).count() == 0
    nothing = docs.select(F.lit(None).cast("array<int>").alias("ids"))
    assert {r.decoded for r in bpe.decode(nothing, RANKS).collect()} == {b""}
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN)


def test_unknown_ids_are_refused(documents):
    bad = documents([(1, "a")]).select(F.array(F.lit(60000)).alias("ids"))
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(bad, RANKS).collect()


def test_query_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op4_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = WHOLE.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
