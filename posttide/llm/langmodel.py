"""Prediction by partial matching: a byte-context trie learned from a corpus scores every text."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks
from posttide.session import materialize

#: Bytes of context. A text begins after and ends with a byte that UTF-8 never uses.
ORDER = 4
EDGE = b"\xff"
BYTE = np.uint64(255)
EIGHT = np.uint64(8)
SLICE = 1 << 20


def windows(padded: bytes) -> np.ndarray:
    """For every byte after the first ORDER ones, the ORDER bytes before and the byte as one number."""
    data = np.frombuffer(padded, np.uint8)
    found = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        found |= data[ORDER - k:len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return found


def grams(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The numbers of all bytes of the texts and of their ends, about `size` at a time: places of the texts, the
    numbers, and where those of each text begin. Long texts come in several slices."""
    held, n = [], 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray]:
        numbers = windows(b"".join(EDGE * ORDER + texts[i] + EDGE for i in held))
        sizes = np.array([len(texts[i]) + 1 for i in held], np.int64)
        ends = np.cumsum(sizes)
        inside = np.ones(len(numbers), bool)
        edges = ends[:-1] + ORDER * np.arange(len(held) - 1)
        for k in range(ORDER):
            inside[edges + k] = False
        return held, numbers[inside], ends - sizes

    for i, text in enumerate(texts):
        if len(text) > size:
            padded = EDGE * ORDER + text + EDGE
            for a in range(0, len(text) + 1, size):
                yield [i], windows(padded[a:a + size + ORDER]), np.zeros(1, np.int64)
            continue
        held.append(i)
        n += len(text) + 1
        if n > size:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def all_distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of the texts in order, and their counts."""
    found = [distinct_counts(numbers) for _, numbers, _ in grams(texts)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(*(np.concatenate(x) for x in zip(*found)))[:2]


def distinct_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, sums of values, and the place of each key among the distinct ones."""
    table, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(table), np.int64)
    np.add.at(sums, at, values)
    return table, sums, at


class Level:
    """What contexts of k bytes have seen: counts by context and byte, totals and distinct bytes by context."""

    def __init__(self, k: int, known: np.ndarray, counts: np.ndarray):
        self.k = k
        self.keys, self.counts, _ = summed(known & self.mask, counts)
        self.contexts, self.n, self.owner = summed(self.keys >> EIGHT, self.counts)
        self.d = np.bincount(self.owner, minlength=len(self.contexts))

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << 8 * (self.k + 1)) - 1)

    def lower_counts(self, below: np.ndarray) -> np.ndarray:
        """By context, the sum of what the next shorter context counts for the bytes seen here; `below` by key."""
        total = np.zeros(len(self.contexts), np.int64)
        np.add.at(total, self.owner, below)
        return total

    def look_up(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the asked numbers, places of their contexts, and whether the contexts are there."""
        key, hit = find(self.keys, asked & self.mask)
        at, there = find(self.contexts, (asked & self.mask) >> EIGHT)
        return pick(self.counts, key, hit), at, there


def pick(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(there, values[at], 0) if len(values) else np.zeros(len(at), np.int64)


def ppm(asked: np.ndarray, known: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probabilities of the numbers `asked` (ORDER bytes of context and a byte).

    `known` and `counts` hold the training counts of all such numbers that share the last two context bytes with
    an asked one; `pairs` is the 256 x 256 table of counts of a byte after a byte. A context that has seen n bytes,
    d of them different, gives a byte seen c times c / (n + d) and escapes to the next shorter context with
    d / (n + d). There, bytes that the longer contexts have seen are excluded from n and d. After the empty
    context the bytes never seen share what is left evenly.
    """
    known, counts = known[counts > 0], counts[counts > 0]
    result, escaped = np.zeros(len(asked)), np.ones(len(asked), bool)

    def step(count: np.ndarray, n: np.ndarray, d: np.ndarray) -> None:
        whole = (n + d).astype(float)
        here = escaped & (count > 0)
        result[here] += np.log10(count[here] / whole[here])
        escaped[here] = False
        on = escaped & (whole > 0)
        result[on] += np.log10(d[on] / whole[on])

    gone_n = gone_d = np.zeros(len(asked), np.int64)
    levels = [Level(k, known, counts) for k in range(ORDER, 1, -1)]
    for level, below in zip(levels, [*levels[1:], None]):
        count, at, there = level.look_up(asked)
        step(count, pick(level.n, at, there) - gone_n, pick(level.d, at, there) - gone_d)
        if below is None:
            lower = pairs[(level.keys >> EIGHT) & BYTE, level.keys & BYTE]
        else:
            lower = below.counts[np.searchsorted(below.keys, level.keys & below.mask)]
        gone_n, gone_d = pick(level.lower_counts(lower), at, there), pick(level.d, at, there)
    symbol, last = asked & BYTE, (asked >> EIGHT) & BYTE
    once, zero = pairs > 0, pairs.sum(axis=0)
    step(pairs[last, symbol], pairs.sum(axis=1)[last] - gone_n, once.sum(axis=1)[last] - gone_d)
    step(zero[symbol], int(zero.sum()) - (once @ zero)[last], int((zero > 0).sum()) - once.sum(axis=1)[last])
    result[escaped] -= np.log10(256 - int((zero > 0).sum()))
    return result


class Lookup:
    """Values by number: a chain of small tables, one byte further in each."""

    def __init__(self, asked: np.ndarray, values: np.ndarray):
        self.symbol = np.zeros(256, np.int64)
        used = np.unique(np.concatenate([(asked >> np.uint64(8 * k)) & BYTE for k in range(ORDER + 1)]))
        self.symbol[used] = np.arange(len(used))
        self.width = len(used)
        self.tables = []
        place = np.zeros(len(asked), np.int64)
        for k in range(ORDER, 0, -1):
            cell = place * self.width + self.symbol[(asked >> np.uint64(8 * k)) & BYTE]
            distinct, place = np.unique(cell, return_inverse=True)
            table = np.zeros((int(distinct[-1]) + 1) if len(distinct) else 1, np.int32)
            table[distinct] = np.arange(len(distinct))
            self.tables.append(table)
        cell = place * self.width + self.symbol[asked & BYTE]
        self.values = np.zeros(int(cell.max()) + 1 if len(cell) else 1)
        self.values[cell] = values

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        place = np.zeros(len(numbers), np.int64)
        for k, table in zip(range(ORDER, 0, -1), self.tables):
            place = table[place * self.width + self.symbol[(numbers >> np.uint64(8 * k)) & BYTE]].astype(np.int64)
        return self.values[place * self.width + self.symbol[numbers & BYTE]]


def pair_table(blocks_of_docs: DataFrame) -> np.ndarray:
    """Counts of a byte after a byte in the training texts; 65,536 cells, so they fit the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                table = blocks.unpack(payload.as_py())
                texts = [t for t, use in zip(blocks.text_bytes(table.column("text")),
                                             table.column("train").to_pylist()) if use]
                for _, found, _ in grams(texts):
                    total += np.bincount((found & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])

    found = blocks_of_docs.mapInArrow(counted, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(1 << 16, np.int64)
    for row in found:
        pairs[row.pair] = row.n
    return pairs.reshape(256, 256)


def gram_part(values: np.ndarray, parts: int) -> np.ndarray:
    """By the last two bytes of context, so that all shorter contexts of a number are in its part."""
    context = (values >> EIGHT) & np.uint64(0xFFFF)
    return ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def score(docs: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score every text by a model of the texts for which `train` is true.

    Returns the columns `keep` (default: all) and n_tokens, n_known, train_tokens, base_score (unigram words with
    add-one smoothing: lower-cased A-Z, words between ASCII white space, one end token a text) and score (log10
    probability of the bytes of the text and its end under the trie).

    Counts of words and of byte contexts cover all training texts. Distinct words and contexts of a block are
    shuffled by value, totalled where they meet, and the answers return to the block. Null texts are empty texts;
    a null `train` counts as false; without training texts all bytes are equally likely. Repeated rows count as
    often as they stand there. Columns named like a result must be renamed before.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    new = {"n_tokens": pa.int64(), "n_known": pa.int64(), "words": pa.float64(), "score": pa.float64()}
    clash = set(keep) & {*new, "train_tokens", "base_score"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("text"),
                         F.coalesce(train, F.lit(False)).alias("train"))
    parts = blocks.parts_for(docs)
    packed = materialize(blocks.make_blocks(source, "text", deal=False), "lm-blocks")
    pairs = pair_table(packed)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    ends = int(pairs[:, 255].sum())

    def asks(payload: bytes) -> Iterator[tuple[int, bytes]]:
        table = blocks.unpack(payload)
        use = table.column("train").to_pylist()
        texts = list(blocks.text_bytes(table.column("text")))
        words: Counter = Counter()
        for value, trained in zip(texts, use):
            for piece in blocks.pieces(value.lower()):
                words.update(piece.split() if trained else dict.fromkeys(piece.split(), 0))
        by_part = defaultdict(lambda: ([], []))
        for word, n in words.items():
            own = by_part[zlib.crc32(word) % parts]
            own[0].append(word)
            own[1].append(n)
        some, n = all_distinct([t for t, trained in zip(texts, use) if trained])
        other, _ = all_distinct([t for t, trained in zip(texts, use) if not trained])
        distinct = np.union1d(some, other)
        counts = np.zeros(len(distinct), np.int64)
        counts[np.searchsorted(distinct, some)] = n
        part = gram_part(distinct, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[cuts[p]:cuts[p + 1]]
            mine = by_part.get(p, ([], []))
            if len(own) or mine[0]:
                row = pa.table({"word": pa.array([mine[0]], pa.list_(pa.binary())),
                                "n": pa.array([mine[1]], pa.list_(pa.int64())),
                                "gram": pa.array([distinct[own]], pa.list_(pa.uint64())),
                                "count": pa.array([counts[own]], pa.list_(pa.int64()))})
                yield p, blocks.pack(row)

    def totalled(_: int, rows: list[bytes]) -> list[bytes]:
        tables = [blocks.unpack(r) for r in rows]
        totals: dict[bytes, int] = defaultdict(int)
        for table in tables:
            for word, n in zip(table.column("word")[0].as_py(), table.column("n")[0].as_py()):
                totals[word] += n

        def numbers(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).chunk(0).values.to_numpy()

        known, counts, _ = summed(np.concatenate([numbers(t, "gram") for t in tables]),
                                  np.concatenate([numbers(t, "count") for t in tables]))
        likely = ppm(known, known, counts, shared.value)
        out = []
        for table in tables:
            words, asked = table.column("word")[0].as_py(), numbers(table, "gram")
            out.append(blocks.pack(pa.table({
                "word": table.column("word"), "n": pa.array([[totals[w] for w in words]], pa.list_(pa.int64())),
                "gram": table.column("gram"),
                "p": pa.array([likely[np.searchsorted(known, asked)]], pa.list_(pa.float64()))})))
        out.append(f"{sum(totals.values())} {sum(n > 0 for n in totals.values())}".encode())
        return out

    def scored(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        table = blocks.unpack(payload)
        texts = list(blocks.text_bytes(table.column("text")))
        counts: dict[bytes, int] = {}
        answers = [blocks.unpack(r) for r in replies.values()]
        for reply in answers:
            counts.update(zip(reply.column("word")[0].as_py(), reply.column("n")[0].as_py()))
        asked = np.concatenate([r.column("gram").chunk(0).values.to_numpy() for r in answers])
        likely = np.concatenate([r.column("p").chunk(0).values.to_numpy() for r in answers])
        look_up, total = Lookup(asked, likely), np.zeros(len(texts))
        for places, numbers, begins in grams(texts):
            total[places] += np.add.reduceat(look_up(numbers), begins)
        rows = {"n_tokens": [], "n_known": [], "words": [], "score": total}
        for value in texts:
            n, known, logs = 1, int(ends > 0), float(np.log10(ends + 1))
            for piece in blocks.pieces(value.lower()):
                words = piece.split()
                found = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
                n, known = n + len(found), known + int((found > 0).sum())
                logs += float(np.log10(found + 1).sum())
            for name, x in zip(("n_tokens", "n_known", "words"), (n, known, logs)):
                rows[name].append(x)
        result = table.drop_columns(["text", "train"])
        for name, kind in new.items():
            result = result.append_column(name, pa.array(rows[name], kind))
        return result

    answers = materialize(blocks.answer(blocks.ask(packed, asks), totalled, extra="total"), "lm-answers")
    totals = F.split(F.col("answer").cast("string"), " ")
    sums = answers.where("block = 'total'").agg(F.sum(totals[0].cast("bigint")), F.sum(totals[1].cast("bigint"))).first()
    tokens, vocabulary = (sums[0] or 0) + ends, (sums[1] or 0) + int(ends > 0)
    schema = T.StructType([f for f in source.schema if f.name in names] + [
        T.StructField(n, T.LongType() if t == pa.int64() else T.DoubleType()) for n, t in new.items()])
    result = blocks.assemble(packed.repartition("block"), answers.where("block <> 'total'"), scored, schema)
    each = F.lit(float(np.log10(tokens + vocabulary + 1)))
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_tokens", "n_known",
                         F.lit(tokens).cast("bigint").alias("train_tokens"),
                         (F.col("words") - F.col("n_tokens") * each).alias("base_score"), "score")
