"""Ranked lexical search: short posting lists term at a time, then documents at a time with skipping.

Documents are indexed in blocks of bounded size, for the terms that are asked for. In a block, an item's short lists
are summed into accumulators, one list of partial scores. That list and the long ones are then iterators with a known
largest value each: iterators that cannot lift a document to the score to beat even together are only consulted for
documents that the others bring up, and only while the document can still get there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks
from posttide.session import materialize

#: Items of one pass over the index, by bytes of their texts.
SLICE_BYTES = 4 << 20
#: A block ends with so many documents or bytes of text.
BLOCK_DOCUMENTS = 4096
BLOCK_BYTES = 16 << 20
#: A list is short while it holds at most one in so many documents of its block.
SHORT = 32
#: One in so many blocks is searched first, for scores to beat everywhere else.
PRIMED = 64
#: Every byte as a term has it: A-Z lower-cased, what separates terms a blank.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
INDEX_SCHEMA = ("block string, n_docs bigint, n_terms bigint, terms array<int>, holding array<bigint>, docs binary, "
                "postings binary")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    for piece in blocks.pieces(text):
        yield piece.translate(FOLDED).split()


def item_slices(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple]]:
    """(id, text) of the items in slices of about `SLICE_BYTES`; a slice at a time comes to the driver."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += len(row.t) + 64
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def index(docs: DataFrame, terms: Broadcast, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """Blocks of documents (columns doc_id, text): how many documents have a term, how many terms they have, and the
    postings of the terms asked for (a dictionary from term to number)."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, split, made = terms.value, TaskContext.get().partitionId(), 0
        known = numbers.get

        def new() -> dict:
            return {"docs": 0, "terms": 0, "size": 0, "id": [], "n": [], "term": [], "tf": [], "many": []}

        def flush(b: dict) -> pa.RecordBatch:
            place = np.repeat(np.arange(len(b["many"])), b["many"])
            term, tf = np.array(b["term"], np.int32), np.array(b["tf"], np.int64)
            order = np.argsort(term, kind="stable")
            term, place, tf = term[order], place[order], tf[order]
            found, holding = np.unique(term, return_counts=True)
            packed = blocks.pack(pa.table({"place": pa.array(place, pa.int32()), "tf": pa.array(tf)}))
            listed = blocks.pack(pa.table({"doc_id": pa.array(b["id"], pa.int64()), "n": pa.array(b["n"], pa.int64())}))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{split}-{made}"]), pa.array([b["docs"]], pa.int64()), pa.array([b["terms"]], pa.int64()),
                 pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([holding.tolist()], pa.list_(pa.int64())),
                 pa.array([listed], pa.binary()), pa.array([packed], pa.binary())],
                ["block", "n_docs", "n_terms", "terms", "holding", "docs", "postings"])

        b = new()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), blocks.text_bytes(batch.column("text"))):
                count, n = Counter(), 0
                for words in terms_of(text):
                    n += len(words)
                    count.update(map(known, words))
                count.pop(None, None)  # terms that no item has
                b["docs"] += n > 0
                b["terms"] += n
                b["size"] += len(text)
                if count:
                    b["id"].append(doc_id)
                    b["n"].append(n)
                    b["many"].append(len(count))
                    b["term"].extend(count.keys())
                    b["tf"].extend(count.values())
                if len(b["id"]) >= block_documents or b["size"] >= BLOCK_BYTES:
                    yield flush(b)
                    b, made = new(), made + 1
        if b["size"] or b["docs"]:
            yield flush(b)

    return docs.mapInArrow(indexed, INDEX_SCHEMA)


class Lists:
    """The posting lists of one block with the scores they give: places in order, scores, and the largest score."""

    def __init__(self, terms: list[int], holding: list[int], docs: pa.Table, postings: pa.Table, weights: np.ndarray,
                 n_docs: int, n_terms: int):
        self.doc_ids = docs.column("doc_id")
        n = docs.column("n").to_numpy()
        if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
            length = np.array([50 * int(x) * n_docs // n_terms for x in n], np.int64)
        else:
            length = 50 * n * n_docs // max(1, n_terms)
        m = 50 + length
        place, tf = postings.column("place").to_numpy(), postings.column("tf").to_numpy()
        score = 1000000000 * tf // (1000 * tf + 20 * m[place])
        ends = np.cumsum(holding) if holding else np.zeros(0, int)
        self.size, self.lists = len(n), {}
        for t, a, b in zip(terms, ends - np.array(holding, int), ends):
            own = score[a:b] * weights[t]
            self.lists[t] = (place[a:b], own, int(own.max()))


def best_of_block(lists: Lists, wanted: np.ndarray, beat: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents of a block that score at least `beat` (1 or more), by the terms `wanted`."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = [lists.lists[t] for t in wanted if t in lists.lists]
    if sum(top for _, _, top in own) < beat:
        return nothing
    few = [x for x in own if len(x[0]) * short <= lists.size]
    iterators = [x for x in own if len(x[0]) * short > lists.size]
    if few:
        # Term at a time: one list of summed scores, bounded by its largest.
        places = np.unique(np.concatenate([p for p, _, _ in few]))
        scores = np.zeros(lists.size, np.int64)
        for p, s, _ in few:
            scores[p] += s
        scores = scores[places]
        iterators.append((places, scores, int(scores.max())))
    # Document at a time: those with the smallest bounds, which together stay below the score to beat, are skipped to.
    iterators.sort(key=lambda x: x[2])
    reach = np.cumsum([top for _, _, top in iterators])
    skipped = int(np.searchsorted(reach, beat, side="left"))
    partial, seen = np.zeros(lists.size, np.int64), np.zeros(lists.size, bool)
    for p, s, _ in iterators[skipped:]:
        partial[p] += s
        seen[p] = True
    places = np.flatnonzero(seen)
    scores = partial[places]
    for j in range(skipped - 1, -1, -1):
        alive = scores + reach[j] >= beat
        places, scores = places[alive], scores[alive]
        if not len(places):
            return nothing
        p, s, _ = iterators[j]
        at = np.minimum(np.searchsorted(p, places), len(p) - 1)
        scores = scores + np.where(p[at] == places, s[at], 0)
    enough = scores >= beat
    return places[enough], scores[enough]


class Best:
    """The best documents of one item so far: by score, then by id with null ids last."""

    def __init__(self, k: int, beat: int):
        self.k, self.floor = k, max(1, beat)
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def beat(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) >= self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        missing = np.concatenate((self.missing, missing))
        order = np.lexsort((ids, missing, -scores))[:self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def search(found: DataFrame, shared: Broadcast, k: int, short: int = SHORT) -> DataFrame:
    """Rows (item, doc_id, score) that hold the `k` best documents of every item. `shared` has the terms of the
    items, the weights of the terms, N, L and the scores to beat."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, n_docs, n_terms, beat = shared.value
        best = [Best(k, b) for b in beat]
        for batch in batches:
            for row in batch.to_pylist():
                if not row["terms"]:
                    continue
                lists = Lists(row["terms"], row["holding"], blocks.unpack(row["docs"]), blocks.unpack(row["postings"]),
                              weights, n_docs, n_terms)
                missing = lists.doc_ids.is_null().to_numpy()
                ids = lists.doc_ids.fill_null(0).to_numpy()
                for own, terms in zip(best, wanted):
                    places, scores = best_of_block(lists, terms, own.beat, short)
                    if len(places):
                        own.add(scores, ids[places], missing[places])
        for i, own in enumerate(best):
            if len(own.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.ids), i)), pa.array(own.ids, mask=own.missing), pa.array(own.scores)],
                    ["item", "doc_id", "score"])

    return found.select("terms", "holding", "docs", "postings").mapInArrow(
        searched, "item bigint, doc_id bigint, score bigint")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id",
                   item_text: str = "text", item_id: str = "item_id", block_documents: int = BLOCK_DOCUMENTS,
                   short: int = SHORT) -> DataFrame:
    """The `k` highest-scoring documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    A text's terms are its runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. With N documents that
    have a term, L terms in all and n in one document, a term that df documents hold weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document's m is 50 + (50 n N) div L, and its score sums
    weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms, in whole numbers. Equal scores come by
    ascending id, null ids last. Null and empty texts have no terms and are never found; items without terms, or
    none at all, give no rows; repeated rows on either side count each. Other columns are left out.

    The index holds the postings of the items' terms; it is written once per slice of the items, whose size is
    fixed, and read twice. A few blocks give scores to beat, then a task sends on `k` rows per item at most.
    """
    spark, result = docs.sparkSession, None
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = items.schema[item_id].dataType
    for held in item_slices(items, item_text, item_id):
        numbers: dict[bytes, int] = {}
        wanted = []
        for _, body in held:
            words = {w for part in terms_of(body.encode("utf-8", "replace")) for w in part}
            wanted.append(np.array(sorted({numbers.setdefault(w, len(numbers)) for w in sorted(words)}), np.int64))
        found = materialize(index(source, spark.sparkContext.broadcast(numbers), block_documents), "postings")
        n_blocks, n_docs, n_terms = found.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_blocks:
            continue
        held_by = np.zeros(len(numbers), np.int64)
        counts = found.select(F.explode(F.arrays_zip("terms", "holding")).alias("t"))
        for term, n in counts.groupBy("t.terms").agg(F.sum("t.holding")).collect():  # the terms of one slice
            held_by[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in held_by], np.int64)
        beat = [0] * len(held)

        def share(beat: list[int]) -> Broadcast:
            return spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms, beat))

        primed = F.pmod(F.xxhash64("block"), F.lit(PRIMED)) == 0
        first = materialize(ranked(search(found.where(primed), share(beat), k, short), k), "primed")
        for item, score in first.where(F.col("rank") == k).select("item", "score").collect():  # one row per item
            beat[item] = score
        rest = search(found.where(~primed), share(beat), k, short)
        best = ranked(first.drop("rank").unionByName(rest), k)
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(held)], T.StructType(
            [T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = best if result is None else result.unionByName(best)
    if result is None:
        result = spark.createDataFrame([], T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return result
