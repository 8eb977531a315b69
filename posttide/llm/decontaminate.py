"""Benchmark decontamination: shared q-grams are counted in diagonal bands, and banded alignment verifies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks

#: Longest q-grams; shorter benchmark texts are never looked for.
Q = 10
#: Edits allowed per byte of a benchmark text.
EDIT_RATE = 0.08
#: Shared q-grams of texts and benchmark that are counted at a time.
POSTINGS = 1 << 21
#: Cells of the passages that are aligned at a time.
CELLS = 1 << 22
#: A benchmark larger than this is searched for slice by slice, in several passes.
SLICE_BYTES = 16 << 20
TABLE_BITS = 22
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Lower case, digits and bytes above ASCII stay; other bytes become spaces.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(FOLD).split())


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes from every position on, q at most ten. Equal bytes have equal hashes; different ones that
    share a hash only add to a count, and alignment decides."""
    n = len(data) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    one = np.zeros(len(data) + 7, np.uint64)
    one[:len(data)] = data
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    head = eight[:n] >> np.uint64(8 * max(8 - q, 0))
    mixed = (head ^ head >> np.uint64(29)) * ODD[0]
    if q > 8:
        mixed += two[q - 2:q - 2 + n] * ODD[1]
    return (mixed ^ mixed >> np.uint64(32)) * ODD[0]


def budget(length: int, rate: float = EDIT_RATE) -> tuple[int, int, int]:
    """Edits allowed for a benchmark text, the length of its q-grams, and how many of them it then shares for sure.

    An edit destroys at most q of its length - q + 1 q-grams; q is the largest length up to ten that leaves one.
    """
    edits = math.floor(rate * length)
    q = min(Q, length // (edits + 1))
    return edits, q, length - q + 1 - edits * q


@dataclass
class Index:
    """Positions of all q-grams of those texts of a slice of the benchmark that have one q."""

    q: int
    ids: list
    texts: list[bytes]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    edits: np.ndarray
    least: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[bytes], rate: float = EDIT_RATE, q: int | None = None) -> Index:
        """Of texts of at least ten bytes; `q`: the least that any of them needs, if not given."""
        usable = [i for i, t in enumerate(texts) if len(t) >= Q]
        ids, texts = [ids[i] for i in usable], [texts[i] for i in usable]
        q = min((budget(len(t), rate)[1] for t in texts), default=Q) if q is None else q
        hashes = [gram_hashes(np.frombuffer(t, np.uint8), q) for t in texts]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[every >> np.uint64(64 - TABLE_BITS)] = True
        size = np.array([len(t) for t in texts], np.int64)
        edits = np.array([budget(len(t), rate)[0] for t in texts], np.int64)
        return cls(q, ids, texts, keys, np.append(first, len(every)), item[order], place[order], table,
                   edits, size - q + 1 - edits * q)


def indexes(ids: list, texts: list[bytes], rate: float = EDIT_RATE) -> list[Index]:
    """One index for every q that texts of the slice have: shorter texts have shorter q-grams."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) >= Q:
            groups.setdefault(budget(len(t), rate)[1], []).append(i)
    return [Index.build([ids[i] for i in own], [texts[i] for i in own], rate, q) for q, own in sorted(groups.items())]


def shared_grams(index: Index, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every shared q-gram: its position in data, its place in the index, and how often the benchmark has it."""
    found = []
    for at in range(0, max(len(data) - index.q + 1, 0), blocks.PIECE_BYTES):
        hashes = gram_hashes(data[at:at + blocks.PIECE_BYTES + index.q - 1], index.q)
        hits = np.flatnonzero(index.table[hashes >> np.uint64(64 - TABLE_BITS)])
        values = hashes[hits]
        key = np.minimum(np.searchsorted(index.keys, values), max(len(index.keys) - 1, 0))
        same = index.keys[key] == values
        found.append((hits[same] + at, key[same]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    position, key = (np.concatenate(x) for x in zip(*found))
    return position, key, index.first[key + 1] - index.first[key]


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of three columns in order, and the sum of the counts of each."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    starts = np.flatnonzero(np.append(len(rows) > 0, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def bands(index: Index, position: np.ndarray, key: np.ndarray, fan: np.ndarray, owner: np.ndarray,
          bounds: np.ndarray) -> Iterator[np.ndarray]:
    """(text, item, band) of every band of diagonals that shares enough q-grams with its item.

    Shared q-grams are expanded to the items that have them piece by piece, in the order of their positions. Of the
    counts, only those of bands that a later position can still add to are kept from piece to piece.
    """
    lengths = np.array([len(t) for t in index.texts], np.int64)
    ends = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(fan) // POSTINGS)) + 1, len(position)))
    held, counts, start = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), 0
    for end in ends.tolist():
        many = fan[start:end]
        each = np.repeat(np.arange(start, end), many)
        posting = index.first[key[each]] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        item, text = index.item[posting], owner[each]
        band = (position[each] - bounds[text] - index.place[posting]) // (index.edits[item] + 1)
        table, n = summed(np.stack([text, item, band], axis=1), np.ones(len(text), np.int64))
        # Bands overlap: one that begins a step earlier holds the same q-grams.
        table, total = summed(np.concatenate([held, table, table - (0, 0, 1)]), np.concatenate([counts, n, n]))
        open_ = np.zeros(len(table), bool)
        if end < len(position):
            last = (bounds[table[:, 0]] + (table[:, 2] + 2) * (index.edits[table[:, 1]] + 1) - 1
                    + lengths[table[:, 1]] - index.q)
            open_ = last >= position[end]
        yield table[~open_ & (total >= index.least[table[:, 1]])]
        held, counts, start = table[open_], total[open_], end


def align(patterns: list[bytes], data: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray,
          width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits that turn each pattern into a passage of its text along the diagonals low to low + width - 1, and
    where the passage ends. Text k is data[first[k]:last[k]]; patterns come longest first and go step by step together.
    """
    lengths = np.array([len(p) for p in patterns], np.int64)
    longest, steps = int(lengths[0]), np.arange(width, dtype=np.int32)
    letters = np.zeros((len(patterns), longest), np.uint8)
    letters[np.arange(longest) < lengths[:, None]] = np.frombuffer(b"".join(patterns), np.uint8)
    inside = (first + low)[:, None] + np.arange(longest + width)
    there = (inside >= first[:, None]) & (inside < last[:, None])
    passage = np.full(inside.shape, -1, np.int16)
    passage[there] = data[inside[there]]
    cost = np.zeros((len(patterns), width), np.int32)
    up = np.full((len(patterns), width), 1 << 20, np.int32)
    left = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for i, n in enumerate(left.tolist()):
        up[:n, :-1] = cost[:n, 1:] + 1
        now = np.minimum(cost[:n] + (passage[:n, i:i + width] != letters[:n, i, None]), up[:n])
        cost[:n] = np.minimum.accumulate(now - steps, axis=1) + steps
    best = cost.argmin(axis=1)
    return cost[np.arange(len(patterns)), best], lengths + low + best


def aligned(index: Index, data: np.ndarray, texts: list[bytes], bounds: np.ndarray,
            table: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, end) of the bands of a table that hold a match, many at a time."""
    lengths = np.array([len(t) for t in index.texts], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    edits = index.edits[table[:, 1]]
    table = table[np.lexsort((-lengths[table[:, 1]], edits))]
    start = 0
    while start < len(table):
        allowed = int(index.edits[table[start, 1]])
        width = 2 * (allowed + 1)
        most = max(CELLS // (int(lengths[table[start, 1]]) + width), 1)
        some = table[start:start + most]
        some = some[index.edits[some[:, 1]] == allowed]
        start += len(some)
        first = bounds[some[:, 0]]
        found, ends = align([index.texts[i] for i in some[:, 1].tolist()], data, first, first + sizes[some[:, 0]],
                            some[:, 2] * (allowed + 1), width)
        for k in np.flatnonzero(found <= allowed).tolist():
            yield int(some[k, 0]), int(some[k, 1]), int(found[k]), int(ends[k])


def matches(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) for every benchmark text found in a text, at its best place."""
    gap = b"\x00" * Q
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    bounds = np.cumsum([0] + [len(t) + Q for t in texts])
    position, key, fan = shared_grams(index, data)
    owner = np.searchsorted(bounds, position, side="right") - 1
    enough = np.bincount(owner, minlength=len(texts)) >= index.least.min()
    use = enough[owner]
    position, key, fan, owner = position[use], key[use], fan[use], owner[use]
    if not len(position):
        return
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for table in bands(index, position, key, fan, owner, bounds):
        for o, i, edits, end in aligned(index, data, texts, bounds, table):
            if best.get((o, i), (1,))[0] == 0:
                continue
            pattern = index.texts[i]
            exact = texts[o].find(pattern)
            match = ((0, exact, exact + len(pattern)) if exact >= 0
                     else (edits, max(0, end - len(pattern) - edits), end))
            best[o, i] = min(best.get((o, i), match), match)
    for (o, i), (edits, start, end) in sorted(best.items()):
        yield o, i, start, end, edits


def found_in(searched: list[Index], texts: list[bytes]) -> Iterator[tuple[int, object, int, int, int]]:
    """(text, id, start, end, edits) for every benchmark text of all indexes found in a text."""
    for index in searched:
        for o, i, start, end, edits in matches(index, texts):
            yield o, index.ids[i], start, end, edits


def slices(benchmark: DataFrame, text: str, item_id: str) -> Iterator[tuple[list, list[bytes]]]:
    """The benchmark in slices of bounded size, by a hash of the text."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // SLICE_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        found = part.collect()
        yield [r.id for r in found], [normalised(r.text) for r in found]


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [normalised(t) if t else b"" for t in batch.column(column).to_pylist()]


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
                  item_id: str = "item_id", rate: float = EDIT_RATE) -> DataFrame:
    """Rows for every document and benchmark text that the document contains with at most `rate` edits per byte:
    the columns `keep` (default: all), item_id, start, end and edits.

    Both sides are compared in lower case, with everything but letters and digits as one space; start and end are
    bytes of that form. The q-gram lemma rules out every band of diagonals that cannot hold a match, so none is
    lost; alignment within a band decides. Null and empty texts contain nothing; benchmark texts that are null or
    in that form shorter than ten bytes, which are words that any text may have, are never found; repeated rows on either side are found each. The benchmark travels
    to the tasks in slices of bounded size, one pass over the documents for each.
    """
    if not 0 <= rate < 1:
        raise ValueError("at most one edit per byte is possible, and then everything matches")
    keep = list(docs.columns) if keep is None else list(keep)
    clash = set(keep) & {"item_id", "start", "end", "edits"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("text"))
    kind = benchmark.schema[item_id].dataType
    fields = [T.StructField("item_id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "end", "edits"))]
    schema = T.StructType([*(f for f in source.schema if f.name != "text"), *fields])
    context, found = docs.sparkSession.sparkContext, None
    for ids, texts in slices(benchmark, text, item_id):
        shared = context.broadcast((ids, texts, rate))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searched = indexes(*shared.value)
            for batch in batches:
                for part in blocks.split_rows(batch, "text", blocks.BLOCK_BYTES):
                    rows = list(found_in(searched, _texts(part, "text")))
                    if rows:
                        own = part.take(pa.array([r[0] for r in rows]))
                        yield pa.RecordBatch.from_arrays(
                            [*(own.column(n) for n in names), pa.array([r[1] for r in rows]).cast(
                                batch_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))],
                            [f.name for f in schema])

        from pyspark.sql.pandas.types import to_arrow_type
        batch_type = to_arrow_type(kind)
        part = source.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "item_id", "start", "end", "edits")


def contains(texts_of_slice: Broadcast) -> Callable[[Column], Column]:
    """Whether a text contains a benchmark text of a slice (ids, texts, rate)."""

    @F.arrow_udf(T.BooleanType())
    def contaminated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searched = indexes(*texts_of_slice.value)
        for batch in batches:
            found = []
            for part in blocks.split_array(batch, blocks.PIECE_BYTES):
                hit = {r[0] for r in found_in(searched, [normalised(t) if t else b"" for t in part.to_pylist()])}
                found += [i in hit for i in range(len(part))]
            yield pa.array(found, pa.bool_())
        searched = None
        blocks.release()

    return contaminated


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                        rate: float = EDIT_RATE) -> DataFrame:
    """The rows of `docs` in which `find_passages` finds no benchmark text, with all their columns.

    Rows with null or empty texts stay, repeated rows stay or go together, an empty benchmark removes nothing; very
    long texts are searched whole, and no column name clashes.
    """
    left = docs
    for ids, texts in slices(benchmark, text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, rate))
        left = left.where(~contains(shared)(F.col(f"`{text}`")))
    return left
