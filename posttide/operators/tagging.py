"""Word classes from context and lemmas by word and class.

A tagged table has one row per text: tokens and, for each, one class of `CLASSES`. Counting it gives a model of which
class follows which and which words a class has. The classes of a text are then those of its most likely sequence, so
that one form can be a noun here and a verb there, and its lemma follows the class it has at its place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.functions import text
from posttide.operators.joins import lookup_join, measured_bytes
from posttide.operators.lemmas import SUFFIX_RULES
from posttide.operators.terms import once
from posttide.session import materialize

#: Adjective, noun, other, verb, in the order that settles ties.
CLASSES = ["a", "n", "o", "v"]
#: Scores are whole numbers: a logarithm times this, rounded down. So equal paths are equal, in any order of adding.
SCALE = 1_000_000
#: A table of words up to this size, as JSON, travels to the tasks; a larger one is joined.
DICTIONARY_BYTES = 64 << 20
#: Tasks that the rows of a frequent token are spread over where the table is joined.
TOKEN_SALTS = 4


@dataclass
class Tagger:
    """Scores of a first class, of one class after another (row: the class before), of a word nobody has tagged, and
    the table of words: token, scores (one per class)."""

    first: list[int]
    after: list[list[int]]
    unknown: list[int]
    words: DataFrame


def sequence_counts(tagged: DataFrame, tokens: str = "tokens", classes: str = "classes") -> DataFrame:
    """(kind, before, class, n): how often a class follows another ('class'; '' at the start) and has a word ('word'),
    out of one aggregation. Positions without a token, a class or a known class count for nothing."""
    def marked(pairs: Column) -> Column:
        return F.transform(pairs, lambda x, i: F.array(
            F.struct(F.lit("word").alias("kind"), x[tokens].alias("before"), x[classes].alias("class")),
            F.struct(F.lit("class").alias("kind"), F.when(i == 0, F.lit("")).otherwise(
                F.get(F.col(classes), i - 1)).alias("before"), x[classes].alias("class"))))

    each = tagged.select(F.explode(F.flatten(marked(F.arrays_zip(tokens, classes)))).alias("e"))
    known = F.col("e.class").isin(CLASSES) & F.col("e.before").isNotNull()
    sequence = (F.col("e.kind") == "word") | F.col("e.before").isin("", *CLASSES)
    return each.where(known & sequence).groupBy("e.kind", "e.before", "e.class").agg(F.count("*").alias("n"))


def _score(count: Column, total: Column) -> Column:
    return F.floor(F.log(count.cast("double") / total.cast("double")) * SCALE).cast("bigint")


def train_tagger(tagged: DataFrame, tokens: str = "tokens", classes: str = "classes") -> Tagger:
    """Counts of a tagged table as scores, one added to every count: a class among 4 that can follow, a word among
    all tagged words and one more for the unknown."""
    counts = materialize(sequence_counts(tagged, tokens, classes), "sequence-counts")
    k = len(CLASSES)
    found = {(r["before"], r["class"]): r["n"] for r in counts.where("kind = 'class'").collect()}
    rows = [(i, j, found.get((before, c), 0) + 1, sum(found.get((before, d), 0) for d in CLASSES) + k)
            for i, before in enumerate(["", *CLASSES]) for j, c in enumerate(CLASSES)]
    spark = tagged.sparkSession
    scored = spark.createDataFrame(rows, "i int, j int, n bigint, total bigint").select(
        "i", "j", _score(F.col("n"), F.col("total")).alias("s")).collect()
    cells = {(r.i, r.j): r.s for r in scored}
    words = counts.where("kind = 'word'")
    per_class = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)) for c in CLASSES]
    by_word = words.groupBy(F.col("before").alias("token")).agg(*[n.alias(f"n{j}") for j, n in enumerate(per_class)])
    sizes = by_word.agg(F.count("*"), *[F.coalesce(F.sum(f"n{j}"), F.lit(0)) for j in range(k)]).first()
    totals = [int(sizes[j + 1]) + int(sizes[0]) + 1 for j in range(k)]
    unknown = spark.range(1).select(*[_score(F.lit(1), F.lit(t)) for t in totals]).first()
    table = by_word.select("token", F.array(*[_score(F.col(f"n{j}") + 1, F.lit(t)) for j, t in enumerate(totals)])
                           .alias("scores"))
    return Tagger([cells[0, j] for j in range(k)], [[cells[i + 1, j] for j in range(k)] for i in range(k)],
                  list(unknown), materialize(table, "word-scores"))


def best_path(scores: Column, tagger: Tagger) -> Column:
    """The classes of the best sequence for a list of scores per position. Of equal sequences the one whose last class
    comes first in `CLASSES`, then the one before it, and so on. A fold keeps, per class, the best score of a sequence
    that ends there and the sequence."""
    k = range(len(CLASSES))

    def first(of: list[Column], best: Column, paths: Column) -> Column:
        chosen = F.when(of[0] == best, F.get(paths, F.lit(0)))
        for p in k[1:]:
            chosen = chosen.when(of[p] == best, F.get(paths, F.lit(p)))
        return chosen

    def state(score: list[Column], path: list[Column]) -> Column:
        return F.struct(F.array(*score).alias("score"), F.array(*path).alias("path"))

    def step(held: Column, now: Column) -> Column:
        score, path = [], []
        for c in k:
            of = [F.get(held["score"], F.lit(p)) + F.lit(tagger.after[p][c]).cast("bigint") for p in k]
            best = F.greatest(*of)
            score.append(best + F.get(now, F.lit(c)))
            path.append(F.concat(first(of, best, held["path"]), F.lit(CLASSES[c])))
        return state(score, path)

    def end(held: Column) -> Column:
        of = [F.get(held["score"], F.lit(c)) for c in k]
        return first(of, F.greatest(*of), held["path"])

    def whole(scores: Column) -> Column:
        begin = state([F.get(F.get(scores, F.lit(0)), F.lit(c)) + F.lit(tagger.first[c]).cast("bigint") for c in k],
                      [F.lit(c) for c in CLASSES])
        rest = F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
        return F.when(F.size(scores) > 0, F.split(F.aggregate(rest, begin, step, end), "")).when(
            scores.isNotNull(), F.array().cast("array<string>"))

    return once(scores, whole)


def _lookup(words: pa.Array) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """For a list column the number of each element's word (-1: not there) and the ends of the lists."""
    def numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten().dictionary_encode()
        found = pa.compute.index_in(flat.dictionary.cast(pa.string()), value_set=words).fill_null(-1)
        known = np.append(found.to_numpy(zero_copy_only=False).astype(np.int64), -1)
        places = flat.indices.fill_null(len(known) - 1).to_numpy()
        return known[places], np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0))))

    return numbers


def _lists(values: pa.Array, ends: np.ndarray, like: pa.Array) -> pa.Array:
    mask = pa.array(np.asarray(like.is_null())) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


def _collected(table: DataFrame, values: str, kind: pa.DataType) -> tuple[pa.Array, list[pa.Array]]:
    """The words of a table of a checked size and, per class, their values: as Arrow columns, since a Python object
    for every word and value takes ten times their size."""
    found = table.select("token", *[F.get(values, F.lit(j)).alias(f"v{j}") for j in range(len(CLASSES))]).toArrow()
    words, *columns = (pa.concat_arrays([part.cast(t) for part in found.column(i).chunks] or [pa.array([], t)])
                       for i, t in enumerate([pa.string(), *[kind] * len(CLASSES)]))
    return words, columns


def _scores_of(table: DataFrame, unknown: list[int]) -> Callable[[Column], Column]:
    """A table of words and scores as a function of a token list, for tables of a checked size."""
    words, columns = _collected(table, "scores", pa.int64())
    shared = table.sparkSession.sparkContext.broadcast(
        (words, np.stack([np.append(c.to_numpy(), u) for c, u in zip(columns, unknown)], axis=1)))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def scores(tokens: pa.Array) -> pa.Array:
        words, values = shared.value
        number, ends = _lookup(words)(tokens)
        width = values.shape[1]
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1) * width, pa.int32()),
                                         pa.array(values[number].ravel()))
        return _lists(inner, ends, tokens)

    return scores


def _lemmas_of(table: DataFrame) -> Callable[[Column, Column], Column]:
    """A table of words and lemmas per class as a function of a token list and its classes."""
    words, columns = _collected(table, "lemmas", pa.string())
    shared = table.sparkSession.sparkContext.broadcast((words, pa.concat_arrays(columns)))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def lemmas(tokens: pa.Array, classes: pa.Array) -> pa.Array:
        words, values = shared.value
        number, ends = _lookup(words)(tokens)
        kind, _ = _lookup(pa.array(CLASSES))(classes)
        place = pa.array(kind * len(words) + number, mask=(number < 0) | (kind < 0))
        return _lists(pa.compute.coalesce(values.take(place), tokens.flatten()), ends, tokens)

    return lemmas


def _with_map(df: DataFrame, table: DataFrame, value: str, tokens: str, key: str, name: str) -> DataFrame:
    """Adds `name`, a map from the tokens of a row that the table knows to their values; for tables too large to
    travel. Only distinct tokens and their values are shuffled, and nothing is broadcast. A row has a token once, so
    none has more than a small share of all, and the table is repeated for few salts."""
    distinct = df.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    known = lookup_join(distinct, table.select("token", value), ["token"], "inner", max_bytes=0, salts=TOKEN_SALTS)
    found = (known.groupBy(key)
             .agg(F.map_from_entries(F.collect_list(F.struct("token", value))).alias(name)))
    return df.join(found.hint("merge"), key, "left")


def tag_in_context(df: DataFrame, tagger: Tagger, tokens: str = "tokens", key: str = "row_key",
                   name: str = "classes", max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Add the classes of the tokens of each row, by the best sequence of the whole list; no tokens, no classes.

    While the tagger's words are at most `max_bytes` large they travel to the tasks and no row is shuffled. Beyond,
    the distinct tokens of the rows, known by `key`, are joined to them.
    """
    if measured_bytes(tagger.words) <= max_bytes:
        scores = _scores_of(tagger.words, tagger.unknown)(F.col(tokens))
    else:
        df = _with_map(materialize(df, "tokens"), tagger.words, "scores", tokens, key, "_scores")
        unknown = F.array(*[F.lit(s).cast("bigint") for s in tagger.unknown])
        scores = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_scores", t), unknown))
    return df.withColumn(name, best_path(scores, tagger)).drop("_scores")


def lemmas_by_class(lexicon: DataFrame) -> DataFrame:
    """Every form that has a lemma other than itself: token, lemmas (one per class, null where none).

    A listed form of a class wins over the suffix rules of that class, the more frequent lemma over the rarer, an
    earlier rule over a later one. Rules run backwards from the lemmas, so the lexicon bounds the table.
    """
    listed = lexicon.where("surface is not null and lemma is not null and pos is not null").select(
        F.col("surface").alias("token"), "pos", F.lit(-1).alias("rule"), (-F.col("freq")).alias("rare"), "lemma")
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(pos).alias("rule_pos"), F.lit(ending).alias("ending"),
                               F.lit(base).alias("base")) for i, (pos, ending, base) in enumerate(SUFFIX_RULES)])
    stem = F.expr("left(lemma, length(lemma) - length(r.base))")
    derived = (lexicon.where("lemma is not null").select("lemma", "pos").distinct()
               .select("lemma", "pos", F.explode(rules).alias("r"))
               .where((F.col("pos") == F.col("r.rule_pos")) & F.endswith("lemma", F.col("r.base")))
               .select(F.concat(stem, F.col("r.ending")).alias("token"), "pos", "r.rule", F.lit(0).alias("rare"), "lemma"))
    best = F.struct("rule", "rare", "lemma")
    each = [F.min(F.when(F.col("pos") == c, best))["lemma"] for c in CLASSES]
    return (listed.unionByName(derived).groupBy("token").agg(F.array(*each).alias("lemmas"))
            .where(F.exists("lemmas", lambda x: x != F.col("token"))))


def lemmatize_in_context(df: DataFrame, lexicon: DataFrame, tokens: str = "tokens", classes: str = "classes",
                         key: str = "row_key", max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Replace each token by the lemma that its word has for the class at its place; others stay, in order."""
    table = materialize(lemmas_by_class(lexicon), "lemmas-by-class")
    if measured_bytes(table) <= max_bytes:
        return df.withColumn(tokens, _lemmas_of(table)(F.col(tokens), F.col(classes)))
    df = _with_map(materialize(df, "classes"), table, "lemmas", tokens, key, "_lemmas")
    number = F.array(*[F.lit(c) for c in CLASSES])

    def lemma(t: Column, c: Column) -> Column:
        return F.coalesce(F.get(F.try_element_at("_lemmas", t), F.array_position(number, c).cast("int") - 1), t)

    return df.withColumn(tokens, F.zip_with(tokens, classes, lemma)).drop("_lemmas")


def clean_heavy_in_context(df: DataFrame, tagger: Tagger, lexicon: DataFrame, stopwords: Sequence[str] | None = None,
                           column: str = "text", key: str = "row_key", max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Replace a text column by its cleaned tokens, lemmatised by class. All tokens take part in the classes; stop
    words are known by their form and dropped before lemmas are looked up."""
    drop = sorted(set(text.STOPWORDS if stopwords is None else stopwords))
    tagged = tag_in_context(df.withColumn(column, text.heavy_words(F.col(column))), tagger, column, key, "_classes",
                            max_bytes)
    pairs = once(F.arrays_zip(F.col(column).alias("t"), F.col("_classes").alias("c")),
                 lambda each: F.filter(each, lambda x: ~x["t"].isin(drop)) if drop else each)
    kept = tagged.withColumn("_kept", pairs).withColumns({
        column: F.transform("_kept", lambda x: x["t"]), "_classes": F.transform("_kept", lambda x: x["c"])})
    return lemmatize_in_context(kept.drop("_kept"), lexicon, column, "_classes", key, max_bytes).drop("_classes")
