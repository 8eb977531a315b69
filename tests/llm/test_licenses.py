import random
from collections import Counter

import pytest
from compare import compare
from pyspark.sql import functions as F

from posttide.llm import licenses, queries

TEMPLATES = {"mit": "Released under the MIT License.", "long": "one two three four five six seven eight nine ten",
             "word": "license", "twice": "a b a b a b"}


def plain(text, template, least):
    """Best coefficient over all runs of lines."""
    def words(t):
        return "".join(c if c.isalnum() or c == "\n" else " " for c in t.lower())
    target = words(template).split()
    want = Counter(zip(target, target[1:]))
    lines = [line.split() for line in words(text or "").split("\n")]
    best = 0.0
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            run = [w for line in lines[i:j + 1] for w in line]
            have = Counter(zip(run, run[1:]))
            total = have.total() + want.total()
            if want and total:
                best = max(best, 2 * (have & want).total() / total)
    return best if best >= least else None


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_equals_brute_force(documents, least):
    rng = random.Random(1)
    words = "released under the mit license one two three four five six seven eight nine ten a b x".split()
    texts = []
    for _ in range(120):
        base = rng.choice(list(TEMPLATES.values())).split() + [rng.choice(words) for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append("".join(w.upper() + rng.choice([" ", "\n", ", ", "\n\n"]) for w in base))
    texts += [None, "", "license", "the", texts[0], "x " * 4000 + "\nReleased under the MIT-License\n" + "y " * 4000]
    found = licenses.scan_licenses(documents(list(enumerate(texts))), TEMPLATES, least=least).collect()
    got = {(r.doc_id, r.license): round(r.dice, 9) for r in found}
    assert len(got) == len(found)
    expected = {(i, n): round(plain(t, v, least), 9) for i, t in enumerate(texts) for n, v in TEMPLATES.items()
                if plain(t, v, least)}
    assert got == expected and any(k[0] == len(texts) - 1 for k in got)


def test_built_in_notices_are_found_where_they_stand(documents):
    text = "prose\n" + licenses.TEMPLATES["Apache-2.0-header"].replace(". ", ".\n") + "\nmore prose"
    rows = {r.license: (r.first_line, r.last_line) for r in licenses.scan_licenses(documents([(1, text)])).collect()}
    assert rows["Apache-2.0-header"][0] == 1


def test_empty_table_and_clashing_names(documents):
    docs = documents([(None, "All rights reserved."), (2, "nothing")]).withColumn("c0", F.lit(5))
    found = licenses.scan_licenses(docs)
    assert [(r.doc_id, r.license, r.c0) for r in found.collect()] == [(None, "all-rights-reserved", 5)]
    assert licenses.scan_licenses(docs.where("doc_id > 9")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs.withColumn("dice", F.lit(1)))


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, queries.op6_license_scan, queries.ORACLE["op6_license_scan"]) is None


def plain_span(text, template, least):
    """Best coefficient over all runs of words."""
    def words(t):
        return "".join(c if c.isalnum() else " " for c in t.lower()).split()
    target, given, best = words(template), words(text or ""), 0.0
    want = Counter(zip(target, target[1:]))
    for i in range(len(given)):
        for j in range(i + 2, min(len(given), i + 5 * len(target)) + 1):
            have = Counter(zip(given[i:j], given[i + 1:j]))
            if want:
                best = max(best, 2 * (have & want).total() / (have.total() + want.total()))
    return best if best >= least else None


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_spans_equal_brute_force(documents, least):
    rng = random.Random(2)
    words = "released under the mit license one two three four five six seven eight nine ten a b x".split()
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(9))] + rng.choice(list(TEMPLATES.values())).split()
        base += [rng.choice(words) for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append("".join(w.upper() + rng.choice([" ", " ", "\n", ", "]) for w in base))
    texts += [None, "", "license", "the"]
    found = licenses.scan_license_spans(documents(list(enumerate(texts))), TEMPLATES, least=least).collect()
    expected = {(i, n): round(plain_span(t, v, least), 9) for i, t in enumerate(texts) for n, v in TEMPLATES.items()
                if plain_span(t, v, least)}
    assert {(r.doc_id, r.license): round(r.dice, 9) for r in found} == expected and len(found) == len(expected)


def test_notices_inside_longer_lines_are_found(documents):
    whole = "prose " * 300 + licenses.TEMPLATES["Apache-2.0-header"] + " more" * 300
    docs = documents([(1, "Copyright 2020 Foo. All rights reserved."), (2, whole), (3, "a\nb all\nrights reserved c")])
    assert licenses.scan_licenses(docs).where("doc_id < 3").count() == 0
    rows = {(r.doc_id, r.license): r for r in licenses.scan_license_spans(docs).collect()}
    short, long, three = rows[1, "all-rights-reserved"], rows[2, "Apache-2.0-header"], rows[3, "all-rights-reserved"]
    assert (short.dice, short.first_word, short.last_word, short.first_line) == (1.0, 3, 5, 0)
    assert (long.dice, long.first_word, long.last_line) == (1.0, 300, 0)
    assert (three.first_word, three.last_word, three.first_line, three.last_line) == (2, 4, 1, 2)


def test_span_query_finds_all_that_lines_find(spark, sf_dir):
    spans = {(r.doc_id, r.license): r.dice for r in queries.op6_license_spans(spark, sf_dir).collect()}
    lines = {(r.doc_id, r.license): r.dice for r in queries.op6_license_scan(spark, sf_dir).collect()}
    assert lines and all(spans[k] >= v for k, v in lines.items())
