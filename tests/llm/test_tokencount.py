import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posttide.llm import queries, tokencount

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    MODEL = file.read()
LIBRARY = Tokenizer.from_str(MODEL)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(8)
    pieces = ["word ", "don't", " ", "\n", "'s", "é", "é", "́", "12", "<|endoftext|>", "\x1c", "\x85", "　",
              "漢字", "ΑΣ", "İ", "...", "ﬁ", "x" * 30, " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(90))) for _ in range(150)]
    return texts + [None, "", " \t", "y" * 3000, texts[4], "<|startoftext|>hello <|endoftext|>world"]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (50, 20), (7, 3), (40, 1)])
def test_counts_equal_the_library(documents, chunk, overlap):
    rows = list(enumerate(odd_texts()))
    found = tokencount.count_tokens(documents(rows), MODEL, chunk=chunk, overlap=overlap, limit=20).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r.doc_id][1]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), expected(text)), repr(text)
        assert r.over_limit == (r.n_tokens > 20)


def test_huge_document_in_chunks(documents):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 12))) for _ in range(30000))
    found = tokencount.count_tokens(documents([(1, text), (1, text)]), MODEL, chunk=10000, overlap=64).collect()
    assert [r.n_tokens for r in found] == [expected(text)] * 2


def test_words_longer_than_chunks(documents):
    """Borders without a boundary: inside a word, over several chunks, at both ends of the text."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh1é-") for _ in range(n))
    texts = [word(20000), word(3000) + " " + word(10), word(10) + "  " + word(3000),
             "a b " + word(2500) + " c " + word(1200) + " " + word(1100) + " d", " " * 3000 + word(2000) + " " * 1500]
    found = tokencount.count_tokens(documents(list(enumerate(texts))), MODEL, chunk=1000, overlap=30).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: expected(t) for i, t in enumerate(texts)}


def test_widening_encodes_each_character_twice_at_most():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000)) + " end"
    chunks = [tokencount.encode_chunk(LIBRARY, text[b:b + 5100], b, 5000, 100) for b in range(0, len(text), 5000)]
    calls = []

    def counted():
        calls.append(1)
        return LIBRARY

    assert tokencount.splice(counted, chunks) == expected(text) and len(calls) == 1
    assert sum(len(c["head"]) + len(c["tail"] or "") for c in chunks) <= len(text)


def test_empty_table_null_ids_and_clashing_names(documents):
    docs = documents([(None, "a b"), (2, "c" * 100)]).withColumns(
        {c: F.lit(6) for c in ("row", "begin", "left", "tokens", "c1", "piece")})
    found = tokencount.count_tokens(docs, MODEL, chunk=10, overlap=4)
    assert found.where("row = 6 and begin = 6 and tokens = 6").count() == 2
    assert tokencount.count_tokens(docs.where("doc_id < 0"), MODEL).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs.withColumn("n_tokens", F.lit(1)), MODEL)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.op8_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == expected(texts[r.doc_id]) and r.over_limit == (r.n_tokens > 2048)
