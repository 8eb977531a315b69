import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from posttide.llm import decontaminate as d


def distance(pattern, text):
    """Fewest edits between the pattern and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(above[j - 1] + (p != t), above[j] + 1, row[j - 1] + 1)
    return min(row)


def plain_form(text):
    """Lower case, with everything but ASCII letters and digits and non-ASCII as one space."""
    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (text or "").lower().encode()).strip(b" ")


def expected(texts, items):
    """The documented rule: items of ten bytes and more, eight edits per hundred bytes."""
    found = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            a, b = plain_form(t), plain_form(item)
            if len(b) >= 10 and distance(b, a) <= len(b) * 8 // 100:
                found.add((i, k, distance(b, a)))
    return found


def sample():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "tmrs" for b in "aeiou" for c in ("n", "th", "é")]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 15, 30, 59)] + [None, "", "short", "Tan tan. " * 9]
    texts = []
    for _ in range(50):
        around = [rng.choice(words) for _ in range(rng.randrange(40))]
        inside = list(rng.choice([i for i in items if i]))
        for _ in range(rng.choice([0, 2, 4, 8, 12])):
            at = rng.randrange(len(inside))
            inside[at:at + rng.randrange(2)] = rng.choice(["", "x", "Q", " ", ".."])
        texts.append(" ".join(around) + "\n" + "".join(inside).upper() + "!" + " ".join(around[::-1]))
    return texts + [None, "", texts[0], items[3], "z" * 4000], items


def test_equals_brute_force(documents, spark):
    texts, items = sample()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = d.find_passages(documents(list(enumerate(texts))), benchmark, keep=["doc_id"]).collect()
    got = {(r.doc_id, r.item_id, r.edits) for r in rows}
    want = expected(texts, items)
    assert {g[:2] for g in got} == {w[:2] for w in want} and len(got) == len(rows)
    assert all(g[2] >= dict(((w[0], w[1]), w[2]) for w in want)[g[:2]] for g in got) and len(want) > 20
    kept = {r.doc_id for r in d.remove_contaminated(documents(list(enumerate(texts))), benchmark).collect()}
    assert kept == set(range(len(texts))) - {w[0] for w in want}


def test_several_slices_give_the_same(documents, spark, monkeypatch):
    texts, items = sample()
    docs = documents(list(enumerate(texts)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(d.find_passages(docs, benchmark, keep=["doc_id"]).collect())
    left = sorted(d.remove_contaminated(docs, benchmark).select("doc_id").collect())
    monkeypatch.setattr(d, "SLICE_BYTES", 100)
    assert sorted(d.find_passages(docs, benchmark, keep=["doc_id"]).collect()) == one
    assert sorted(d.remove_contaminated(docs, benchmark).select("doc_id").collect()) == left


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.3, 0.9])
def test_budget_leaves_a_gram(rate):
    for n in range(d.Q, 3000):
        edits, q, least = d.budget(n, rate)
        assert edits == int(rate * n) and 1 <= q <= 10 and least >= 1
        assert q == 10 or n - (q + 1) + 1 - edits * (q + 1) < 1


def test_hashes_are_those_of_the_bytes():
    data = np.frombuffer(b"abracadabra abracadabra xyz", np.uint8)
    for q in range(1, 11):
        hashes = d.gram_hashes(data, q).tolist()
        assert len(hashes) == len(data) - q + 1
        grams = [bytes(data[i:i + q]) for i in range(len(hashes))]
        assert len(set(zip(grams, hashes))) == len(set(grams)) == len(set(hashes))
        assert not len(d.gram_hashes(data[:q - 1], q))


def test_short_items_get_the_full_budget(documents, spark):
    rng = random.Random(11)
    letters = "etaoinshrdlu"
    items = ["x" + "".join(rng.choice(letters) for _ in range(n - 2)) + "y" for n in range(10, 61)]
    texts = []
    for item in items:
        for extra in (0, 1):
            edited = list(item)
            for at in rng.sample(range(1, len(edited) - 1), len(item) * 8 // 100 + extra):
                edited[at] = rng.choice(["", "q"])
            texts.append("some words before " + "".join(edited) + " and after")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = d.find_passages(documents(list(enumerate(texts))), benchmark, keep=["doc_id"]).collect()
    want = expected(texts, items)
    assert {(r.doc_id, r.item_id) for r in found} == {w[:2] for w in want} and len(want) >= 50


def test_counting_in_pieces_finds_the_same(monkeypatch):
    texts, items = sample()
    texts, items = [plain_form(t) for t in texts], [plain_form(t) for t in items]
    texts.append(b" ".join(texts))
    searched = d.indexes(list(range(len(items))), items)
    whole = sorted(d.found_in(searched, texts))
    for size in (1, 50, 3000):
        monkeypatch.setattr(d, "POSTINGS", size)
        assert sorted(d.found_in(searched, texts)) == whole
    assert len(whole) > 20


def test_many_items_that_share_a_stem():
    rng = random.Random(3)
    stem = b"which of the following statements about it is true "
    items = sorted({stem + bytes(rng.choice(b"bcdfghklmnp") for _ in range(14)) for _ in range(50_000)})
    texts = [b"before " + stem + b"nothing of the kind", b"x " + items[123] + b" y", b"z " + items[777][:-1] + b"q"]
    searched = d.indexes(list(range(len(items))), items)
    start = time.monotonic()
    found = {(o, i) for o, i, *_ in d.found_in(searched, texts)}
    assert time.monotonic() - start < 30
    assert {(1, 123), (2, 777)} <= found
    near = [(o, i) for o in range(3) for i in rng.sample(range(len(items)), 15)]
    assert all(((o, i) in found) == (distance(items[i], texts[o]) <= len(items[i]) * 8 // 100) for o, i in near)


def plain_align(pattern, text, low, high):
    """The fewest edits cell by cell, along the diagonals low to high only, and the first place where they end."""
    cost = {k: 0 for k in range(low, high + 1)}
    for i, byte in enumerate(pattern):
        row = {}
        for k in range(low, high + 1):
            same = 0 <= i + k < len(text) and text[i + k] == byte
            row[k] = min(cost[k] + (not same), cost.get(k + 1, 1 << 20) + 1, row.get(k - 1, 1 << 20) + 1)
        cost = row
    best = min(cost, key=lambda k: (cost[k], k))
    return cost[best], len(pattern) + best


def test_alignment():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab ") for _ in range(200)) + b"xx the quick brwn fox yy"
    patterns = [b"the quick brown fox"] + [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    patterns.sort(key=len, reverse=True)
    first = np.array([0 if rng.random() < 0.5 else 190 for _ in patterns])
    last = np.array([224 if f else rng.choice([3, 200, 224]) for f in first])
    low = np.array([rng.randrange(-9, 40) for _ in patterns])
    edits, ends = d.align(patterns, np.frombuffer(data, np.uint8), first, last, low, 6)
    want = [plain_align(p, data[f:t], at, at + 5) for p, f, t, at in zip(patterns, first, last, low.tolist())]
    assert list(zip(edits.tolist(), ends.tolist())) == want
    fox = d.align([b"the quick brown fox"], np.frombuffer(data, np.uint8), np.array([200]), np.array([224]), np.array([-2]), 11)
    assert fox[0][0] == 1


def test_repeats_null_ids_empty_tables_and_clashing_names(documents, spark):
    item = "to thbleor theati hein to ertionnt of antion"
    benchmark = spark.createDataFrame([(None, item), (3, item), (3, item)], "item_id long, text string")
    docs = documents([(None, item), (1, "a " + item), (1, "a " + item), (2, "clean text")]).withColumn("block", F.lit(1))
    found = d.find_passages(docs, benchmark)
    assert found.count() == 9 and found.where("doc_id = 2").count() == 0
    assert [r.doc_id for r in d.remove_contaminated(docs, benchmark).collect()] == [2]
    none = benchmark.where("item_id > 5")
    assert d.find_passages(docs, none).count() == 0 and d.remove_contaminated(docs, none).count() == 4
    assert d.find_passages(docs.where("doc_id > 5"), benchmark).count() == 0
    with pytest.raises(ValueError):
        d.find_passages(docs.withColumn("edits", F.lit(1)), benchmark)
