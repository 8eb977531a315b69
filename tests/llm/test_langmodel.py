import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from posttide.llm import langmodel, queries


def plain_ppm(training, text):
    """Context by context with dictionaries, one byte after the other."""
    seen = defaultdict(Counter)
    edge = b"\xff" * langmodel.ORDER
    for t in training:
        padded = edge + t + b"\xff"
        for i in range(langmodel.ORDER, len(padded)):
            for k in range(langmodel.ORDER + 1):
                seen[padded[i - k:i]][padded[i]] += 1
    padded, total = edge + text + b"\xff", 0.0
    for i in range(langmodel.ORDER, len(padded)):
        excluded = set()
        for k in range(langmodel.ORDER, -1, -1):
            follow = {s: n for s, n in seen[padded[i - k:i]].items() if s not in excluded}
            n, d = sum(follow.values()), len(follow)
            if padded[i] in follow:
                total += math.log10(follow[padded[i]] / (n + d))
                break
            if n:
                total += math.log10(d / (n + d))
            excluded |= set(follow)
        else:
            total -= math.log10(256 - len(excluded))
    return total


def plain_base(training, text):
    counts = Counter(w for t in training for w in t.lower().split())
    n, v = sum(counts.values()) + len(training), len(counts) + bool(training)
    words = text.lower().split()
    total = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(training) + 1) / (n + v + 1))
    return len(words) + 1, sum(counts[w] > 0 for w in words) + bool(training), n, total


def odd_rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "a", "b ", "É", "\n", "Xx", "漢"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += [None, "", " ", texts[1], texts[1], "never seen ☃", "ab " * 900]
    return list(enumerate(texts)) + [(None, "the id is null"), (3, texts[2])]


@pytest.mark.parametrize("nothing_to_learn", [False, True])
def test_equals_brute_force(documents, nothing_to_learn):
    rows = odd_rows()
    learn = F.lit(False) if nothing_to_learn else F.col("doc_id") % 3 != 0
    training = [] if nothing_to_learn else [(t or "").encode() for i, t in rows if i is not None and i % 3]
    got = langmodel.score(documents(rows), learn, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (r.text or "").encode()
        n_tokens, n_known, n, base = plain_base(training, text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain_ppm(training, text), rel=1e-9)


def test_probabilities_sum_to_one_less_what_escapes_lose(documents):
    texts = [b"abab abc", b"bca", b"abd"]
    values = [plain_ppm(texts, b"a" + bytes([s])) - plain_ppm(texts, b"a") for s in b"bcd"]
    assert all(v < 2 for v in values)


def test_empty_table_and_clashing_names(documents):
    docs = documents([(1, "a b"), (2, "b c")]).withColumns({c: F.lit(4) for c in ("train", "n", "block", "c0", "word")})
    found = langmodel.score(docs, F.lit(True))
    assert found.where("train = 4 and n = 4 and word = 4").count() == 2
    assert langmodel.score(docs.where("doc_id < 0"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        langmodel.score(docs.withColumn("score", F.lit(1)), F.lit(True))


def test_query_beats_its_base_on_what_it_did_not_learn(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    rows = queries.op5_ppm_scores(spark, sf_dir).collect()
    training = [(d.text or "").encode() for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2]
    texts = {d.doc_id: (d.text or "").encode() for d in docs}
    counts = Counter(w for t in training for w in t.lower().split())
    assert len(rows) == len(docs)
    for r in rows:
        words = texts[r.doc_id].lower().split()
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.train_tokens == sum(counts.values()) + len(training)
        assert (r.n_tokens, r.n_known) == (len(words) + 1, 1 + sum(w in counts for w in words))
