"""Byte-level BPE: every distinct word is encoded once, wherever it occurs; decoding by the table of token bytes."""

from __future__ import annotations

import base64
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks

BLOCK_BYTES = 8 << 20
LEVEL = 3
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines `base64 rank`, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def two(a: bytes, b: bytes) -> bytes:
    return struct.pack("<Q", len(a)) + a + b


def untwo(data: bytes) -> tuple[bytes, bytes]:
    n, = struct.unpack_from("<Q", data)
    return data[8:8 + n], data[8 + n:]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of their bytes."""
    return squeeze(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Words as compressed lengths and compressed bytes."""
    return two(pack_numbers(np.fromiter(map(len, words), np.int32, len(words))), squeeze(b"".join(words)))


def unpack_words(data: bytes) -> list[bytes]:
    lengths, text = untwo(data)
    ends = np.cumsum(unpack_numbers(lengths))
    text = unsqueeze(text)
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of many runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def dealt(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in order of their part, and where each part begins and ends."""
    part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def pretoken_codes(texts: Iterator[bytes], pattern: regex.Pattern) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of a block; each text as their numbers in order; the number of them per text."""
    number = defaultdict(count().__next__)
    found, lengths = [], []
    for text in texts:
        words = pattern.findall(text.decode("utf-8"))
        found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        lengths.append(len(words))
    codes = np.concatenate(found) if found else np.zeros(0, np.int32)
    return [w.encode() for w in number], codes, np.array(lengths, np.int64)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and ids, the token ids of each text.

    Texts are split by `pattern`. Pre-tokens leave their documents with their positions: a block of documents
    turns into numbers of its distinct pre-tokens. These are shuffled by value, each distinct one is encoded once
    where it arrives, its ids go back to the blocks that asked, and the documents are put together by position.
    Null and empty texts give an empty list; repeated rows stay; a column named ids must be renamed before.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    if "ids" in keep:
        raise ValueError("rename the column 'ids'")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("text"))
    parts = blocks.parts_for(docs)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def prepare(table: pa.Table) -> bytes:
        split = regex.compile(shared.value[1])
        words, codes, lengths = pretoken_codes(blocks.text_bytes(table.column("text")), split)
        kept = table.drop_columns(["text"]).append_column("n", pa.array(lengths))
        return two(two(blocks.pack(kept), pack_numbers(codes)), pack_words(words))

    def asks(payload: bytes) -> Iterator[tuple[int, bytes]]:
        words = unpack_words(untwo(payload)[1])
        order, cuts = dealt(words, parts)
        for p in range(parts):
            own = order[cuts[p]:cuts[p + 1]].tolist()
            if own:
                yield p, pack_words([words[i] for i in own])

    def encoded(_: int, rows: list[bytes]) -> list[bytes]:
        encoder = encoding(*shared.value)
        ids: dict[bytes, list[int]] = {}
        out = []
        for row in rows:
            lengths, flat = [], []
            for word in unpack_words(row):
                if word not in ids:
                    ids[word] = encoder.encode_ordinary(word.decode("utf-8"))
                lengths.append(len(ids[word]))
                flat += ids[word]
            out.append(two(pack_numbers(np.array(lengths, np.int32)), pack_numbers(np.array(flat, np.int32))))
        return out

    def put_together(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        body, words = untwo(payload)
        kept, codes = (f(x) for f, x in zip((blocks.unpack, unpack_numbers), untwo(body)))
        order, cuts = dealt(unpack_words(words), parts)
        starts, sizes, flat, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), [], 0
        for p, reply in replies.items():
            lengths, ids = map(unpack_numbers, untwo(reply))
            own = order[cuts[p]:cuts[p + 1]]
            sizes[own] = lengths
            starts[own] = at + np.cumsum(lengths) - lengths
            flat.append(ids)
            at += len(ids)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        spread = np.concatenate(([0], np.cumsum(sizes[codes])))
        ids = np.empty(spread[-1], np.int32)
        for i in range(0, len(codes), SLICE):
            own = codes[i:i + SLICE]
            ids[spread[i]:spread[i + len(own)]] = flat[ragged(starts[own], sizes[own])]
        ends = spread[np.concatenate(([0], np.cumsum(kept.column("n").to_numpy())))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return kept.drop_columns(["n"]).append_column("ids", lists)

    schema = T.StructType([f for f in source.schema if f.name != "text"] +
                          [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    packed = blocks.make_blocks(source, "text", BLOCK_BYTES, prepare)
    answers = blocks.answer(blocks.ask(packed, asks), encoded)
    result = blocks.assemble(packed, answers, put_together, schema)
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "ids")


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` and `out`, the bytes that its token ids stand for.

    Every id is looked up in the table of token bytes, whose size the vocabulary fixes. A null or empty list gives
    empty bytes; an id without a token is an error.
    """
    spark: SparkSession = docs.sparkSession
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = spark.sparkContext.broadcast((b"".join(tokens), [len(t) for t in tokens]))
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*names)
    column = names[docs.columns.index(ids)]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lengths = (np.frombuffer(shared.value[0], np.uint8), np.array(shared.value[1], np.int64))
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            lists = batch.column(column).cast(pa.large_list(pa.int32()))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= size):
                raise ValueError("a token id outside the vocabulary")
            ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
            decoded = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = flat[a:b]
                decoded.append(data[ragged(starts[own], lengths[own])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*names, "bytes"])
        blocks.release()

    schema = T.StructType([*source.schema.fields, T.StructField("bytes", T.BinaryType())])
    return source.mapInArrow(looked_up, schema).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("bytes").alias(out))
