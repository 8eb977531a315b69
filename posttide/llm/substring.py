"""Substring deduplication: passages of a fixed number of words that occur more than once are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks

WINDOW = 35
#: Bytes of text in a block, and parts for each partition of a shuffle: what a task holds at once follows from both.
BLOCK_BYTES = 2 << 20
PARTS = 2
#: Two odd bases of the rolling hash, and odd factors that mix its bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordHashes(dict):
    """XXH64 of a word, kept for words seen before; emptied when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    found = []
    for piece in blocks.pieces(text):
        words = piece.split()
        found.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp value of every run of `window` values, modulo 2^64: sum of values[i+j] * base^j."""
    n = len(values)
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[:1] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers, out=sums[1:])
    return (sums[window:] - sums[:-window]) * back[: n - window + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    for factor, shift in zip(MIX, (30, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def window_keys(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """80-bit keys (64 and 16 bits) of all windows of a block, and the place of each among the block's words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.flatnonzero(np.arange(len(words)) + window <= ends)
    first, second = (mixed(rolling(words, window, b)[at]) for b in BASES)
    return first, (second >> np.uint64(48)).astype(np.uint16), at


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of `starts`."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of True as word positions, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def kept_words(text: bytes, mask: np.ndarray) -> bytes:
    """The words outside the mask, joined by one space."""
    out, at = [], 0
    for piece in blocks.pieces(text):
        words = piece.split()
        drop = mask[at:at + len(words)]
        out += words if not drop.any() else [w for w, d in zip(words, drop.tolist()) if not d]
        at += len(words)
    return b" ".join(out)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW,
                   keep: list[str] | None = None) -> DataFrame:
    """Find every window of `window` words that starts at two or more places, in one or several texts, and
    remove the words those windows cover.

    Every window of every text gets an 80-bit rolling hash; the hashes meet by value, and those that occur more
    than once are marked; marked windows of a text merge into maximal intervals. All windows are judged on the
    input. Two different windows share a hash with probability 2^-80.

    Returns the columns `keep` (default: all but the text) and n_words, n_removed, removed (intervals of word
    positions, end exclusive) and kept (the words left, joined by one space). A null, empty or blank text has
    no words: 0, 0, no intervals, an empty text. Texts shorter than the window stay whole. Rows that are equal
    are places of their own, so copies remove each other. Columns named like a result column must be left out.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    clash = set(keep) & {"n_words", "n_removed", "removed", "kept"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    names = ["text" if c == text else f"c{i}" for i, c in enumerate(keep)]
    others = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names) if n != "text"]
    source = docs.select(*others, F.col(f"`{text}`").alias("text"))
    parts = PARTS * blocks.parts_for(docs)

    def hashed(payload: bytes):
        table = blocks.unpack(payload)
        cache = WordHashes()
        words = [word_hashes(t, cache) for t in blocks.text_bytes(table.column("text"))]
        return table, words, *window_keys(words, window)

    def asks(payload: bytes) -> Iterator[tuple[int, bytes]]:
        _, _, first, second, _ = hashed(payload)
        part = ((first >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[bounds[p]:bounds[p + 1]]
            if len(own):
                yield p, first[own].tobytes() + second[own].tobytes()

    def repeated(_: int, rows: list[bytes]) -> list[bytes | None]:
        sizes = [len(r) // 10 for r in rows]
        first = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(rows, sizes)])
        second = np.concatenate([np.frombuffer(r, np.uint16, n, 8 * n) for r, n in zip(rows, sizes)])
        order = np.lexsort((second, first))
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        marked = np.zeros(len(first), bool)
        marked[order[1:][same]] = True
        marked[order[:-1][same]] = True
        out, at = [], 0
        for n in sizes:
            own = marked[at:at + n]
            out.append(np.packbits(own).tobytes() if own.any() else None)
            at += n
        return out

    def removed(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        table, words, first, _, at = hashed(payload)
        part = ((first >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
        flags = np.zeros(len(first), bool)
        if replies:
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p, bits in replies.items():
                own = order[bounds[p]:bounds[p + 1]]
                flags[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        total = sum(map(len, words))
        mask = covered(total, at[flags], window)
        rows = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        start = 0
        for value, own in zip(blocks.text_bytes(table.column("text")), words):
            hit = mask[start:start + len(own)]
            start += len(own)
            rows["n_words"].append(len(own))
            rows["n_removed"].append(int(hit.sum()))
            rows["removed"].append(intervals(hit) if hit.any() else [])
            rows["kept"].append(kept_words(value, hit).decode("utf-8", "replace"))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "removed": span, "kept": pa.string()}
        result = table if "text" in names else table.drop_columns(["text"])
        for name, values in rows.items():
            result = result.append_column(name, pa.array(values, types[name]))
        return result

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in source.schema if f.name in names] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", span), T.StructField("kept", T.StringType())])
    packed = blocks.make_blocks(source, "text", BLOCK_BYTES)
    answers = blocks.answer(blocks.ask(packed, asks), repeated)
    result = blocks.assemble(packed, answers, removed, schema)
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, keep)],
                         "n_words", "n_removed", "removed", "kept")
