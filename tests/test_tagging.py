"""Word classes from context, lemmas by word and class."""

import itertools
import math
import random
import tracemalloc

import pytest
from explained import plan_of
from pyspark.sql import functions as F

from posttide.operators import tagging
from posttide.operators.joins import lookup_join
from posttide.session import materialize

WORDS = ["saw", "the", "a", "dog", "cut", "red", "runs"]


def tagged(spark, rows):
    return spark.createDataFrame(rows, "tokens array<string>, classes array<string>").repartition(3)


def sentences(seed, n):
    """Class and word depend on the class before, so that most words have several classes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        classes, tokens = [], []
        for _ in range(rng.randrange(1, 9)):
            classes.append(rng.choice("anov" if not classes else {"a": "nna", "n": "vvo", "o": "an", "v": "onv"}[classes[-1]]))
            tokens.append(rng.choice(WORDS[ord(classes[-1]) % 3:]))
        rows.append((tokens, classes))
    return rows


def plain_model(rows):
    after, word = {}, {}
    for tokens, classes in rows:
        for i, (t, c) in enumerate(zip(tokens, classes)):
            word[t, c] = word.get((t, c), 0) + 1
            before = classes[i - 1] if i else ""
            after[before, c] = after.get((before, c), 0) + 1
    size = len({t for t, _ in word})
    total = {c: sum(n for (_, d), n in word.items() if d == c) + size + 1 for c in tagging.CLASSES}
    follow = {b: sum(after.get((b, c), 0) for c in tagging.CLASSES) + 4 for b in ["", *tagging.CLASSES]}

    def score(n, of):
        return math.floor(math.log(n / of) * tagging.SCALE)

    def path(tokens, classes):
        return sum(score(after.get((b, c), 0) + 1, follow[b]) + score(word.get((t, c), 0) + 1, total[c])
                   for t, b, c in zip(tokens, ["", *classes], classes))

    return path


def all_paths(path, tokens):
    """The best of all sequences; of equal ones the first by its last class, then the one before."""
    if not tokens:
        return []
    every = itertools.product(tagging.CLASSES, repeat=len(tokens))
    return list(min(every, key=lambda p: (-path(tokens, p), p[::-1])))


@pytest.mark.parametrize("max_bytes", [tagging.DICTIONARY_BYTES, 0])
def test_classes_equal_all_paths(spark, max_bytes):
    rows = sentences(1, 200)
    tagger = tagging.train_tagger(tagged(spark, rows))
    path = plain_model(rows)
    rng = random.Random(2)
    texts = [[rng.choice([*WORDS, "unseen"]) for _ in range(n % 7)] for n in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_key long, tokens array<string>").repartition(4)
    got = {r.row_key: r.classes for r in tagging.tag_in_context(df, tagger, max_bytes=max_bytes).collect()}
    assert got == {i: all_paths(path, t) for i, t in enumerate(texts)}


def test_ties_go_to_the_first_class_from_the_end(spark):
    tagger = tagging.train_tagger(tagged(spark, [([], [])]))
    df = spark.createDataFrame([(1, ["x", "y"]), (2, None), (3, [])], "row_key long, tokens array<string>")
    got = {r.row_key: r.classes for r in tagging.tag_in_context(df, tagger).collect()}
    assert got == {1: ["a", "a"], 2: None, 3: []}


LEXICON = [("saw", "n", "saw", 5), ("saw", "v", "see", 2), ("saw", "v", "sow", 1), ("dog", "n", "dog", 1),
           ("walk", "v", "walk", 1), ("better", "a", "good", 1), ("x", None, "y", 1)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "surface string, pos string, lemma string, freq bigint")


@pytest.mark.parametrize("max_bytes", [tagging.DICTIONARY_BYTES, 0])
def test_one_word_has_two_lemmas_in_one_text(spark, max_bytes):
    rows = [(1, ["saw", "saw", "walking", "walking", "dogs", "better", "unknown"], ["n", "v", "v", "n", "n", "a", "n"]),
            (2, [], []), (3, None, None), (4, ["saw", None, "x"], ["o", "n", "v"])]
    df = spark.createDataFrame(rows, "row_key long, tokens array<string>, classes array<string>")
    got = tagging.lemmatize_in_context(df, lexicon(spark), max_bytes=max_bytes)
    assert {r.row_key: r.tokens for r in got.collect()} == {
        1: ["saw", "see", "walk", "walking", "dog", "good", "unknown"], 2: [], 3: None, 4: ["saw", None, "x"]}


def test_noun_and_verb_by_context(spark):
    rows = [(["the", "saw", "cuts"], ["o", "n", "v"])] * 5 + [(["dogs", "saw", "dogs"], ["n", "v", "n"])] * 5
    df = spark.createDataFrame([(1, "The saw saw dogs, and the saw"), (2, None)], "row_key long, text string")
    tagger = tagging.train_tagger(tagged(spark, rows))
    got = tagging.clean_heavy_in_context(df, tagger, lexicon(spark))
    assert [r.text for r in got.orderBy("row_key").collect()] == [["saw", "see", "dog", "saw"], []]


def test_small_tables_shuffle_no_posts(spark):
    tagger = tagging.train_tagger(tagged(spark, sentences(3, 20)))
    df = spark.range(100).select(F.col("id").alias("row_key"), F.lit("the saw runs").alias("text"))
    plan = plan_of(tagging.clean_heavy_in_context(df, tagger, lexicon(spark)))
    assert "Exchange" not in plan and "Join" not in plan


def test_large_tables_are_not_broadcast(spark):
    table = materialize(spark.range(1000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"),
                                                 F.array(*[F.col("id")] * 4).alias("scores")), "words")
    tagger = tagging.Tagger([0] * 4, [[0] * 4] * 4, [0] * 4, table)
    df = spark.range(100).select(F.col("id").alias("row_key"), F.lit("w1 w7 saw").alias("text"))
    cleaned = tagging.clean_heavy_in_context(df, tagger, lexicon(spark), max_bytes=0)
    cleaned.collect()
    assert "Broadcast" not in plan_of(cleaned)
    on_word = df.select("row_key", F.concat(F.lit("w"), F.col("row_key").cast("string")).alias("token"))
    assert "Broadcast" not in plan_of(lookup_join(on_word, table, ["token"], max_bytes=0))


def test_counts_come_from_one_aggregation_and_skip_holes(spark):
    rows = [(["a", None, "b"], ["n", "v", None]), (["c"], ["x"]), (None, None), (["d", "e"], ["n"])]
    counts = tagging.sequence_counts(tagged(spark, rows))
    assert plan_of(counts).count("Exchange hashpartitioning") == 1
    got = {(r.kind, r.before, r["class"]): r.n for r in counts.collect()}
    assert got == {("class", "", "n"): 2, ("word", "a", "n"): 1, ("class", "n", "v"): 1, ("word", "d", "n"): 1}


@pytest.mark.parametrize("travel,value", [("_scores_of", "scores"), ("_lemmas_of", "lemmas")])
def test_words_that_travel_are_no_python_objects(spark, travel, value):
    n = 20_000
    each = F.array(*[F.lit(-1).cast("bigint") if value == "scores" else F.lit("lemma")] * 4)
    table = spark.range(n).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("token"), each.alias(value))
    given = (table, [0, 0, 0, 0]) if value == "scores" else (table,)
    tracemalloc.start()
    getattr(tagging, travel)(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * n
