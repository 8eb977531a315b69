"""Token counts of whole texts; huge documents are encoded as overlapping chunks and spliced where both agree."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from posttide.llm import blocks

CHUNK = 64 << 10
OVERLAP = 512
SPACES = " \t\n\x0b\x0c\r"
JOINED = 1 << 15
MEMORY = 500_000


@functools.lru_cache(maxsize=2)
def loaded(tokenizer: str) -> Tokenizer:
    """The tokenizer of a JSON, read once per worker process."""
    return Tokenizer.from_str(tokenizer)


def starts_of(tokenizer: Tokenizer, text: str) -> np.ndarray:
    """Where each token of a text begins, in characters."""
    found = tokenizer.encode(text, add_special_tokens=False).offsets
    return np.fromiter((a for a, _ in found), np.int64, len(found))


class WordCounts(dict):
    """Tokens of a word. White space ends a word of the library's too, nothing joins across it, so a text has as
    many tokens as its words. New words are encoded many at a time; the table is emptied when large."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list(words)
        held, size = [], 0
        for word in new:
            held.append(word)
            size += len(word) + 1
            if size > JOINED:
                self._encode(held)
                held, size = [], 0
        if held:
            self._encode(held)

    def _encode(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8") for w in words]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.searchsorted(begins, starts_of(self.tokenizer, " ".join(texts)), side="right") - 1
        self.update(zip(words, np.bincount(at, minlength=len(words)).tolist()))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        return [sum(map(self.__getitem__, words)) for words in split]


def boundaries(text: str, starts: np.ndarray, low: int, high: int) -> dict[int, int]:
    """Stable boundaries between low and high: a token begins there, right after white space. The value is the
    number of tokens before it. Whatever stands on the other side of white space never changes a token."""
    first, last = np.searchsorted(starts, (low + 1, high))
    found: dict[int, int] = {}
    for i, p in enumerate(starts[first:last].tolist(), int(first)):
        if text[p - 1] in SPACES:
            found.setdefault(p, i)
    return found


def encode_chunk(tokenizer: Tokenizer, text: str, begin: int, chunk: int, overlap: int) -> dict:
    """A chunk's tokens and its boundaries shared with the chunk before (left) and after (right), as places in
    the document. For a border where the neighbours share none: the text before its own first boundary (head) and
    from its own last one on (tail), each with the number of tokens before that boundary. That is a word in
    ordinary text. A chunk without a boundary is head as a whole."""
    starts = starts_of(tokenizer, text)
    own = boundaries(text, starts, 0, min(chunk, len(text)))
    first, last = (min(own), max(own)) if own else (None, None)
    return {"tokens": len(starts),
            "left": {begin + p: i for p, i in boundaries(text, starts, 0, overlap).items()},
            "right": {begin + p: i for p, i in boundaries(text, starts, chunk, chunk + overlap).items()},
            "head": text[:chunk] if first is None else text[:first], "first": own.get(first),
            "tail": None if last is None else text[last:chunk], "last": own.get(last)}


def splice(tokenizer: Callable[[], Tokenizer], chunks: list[dict]) -> int:
    """Tokens of a document from its chunks in order. Neighbours meet at their first common boundary.

    Without one the overlap is widened to both sides, up to the nearest boundary of a chunk, over chunks without any
    if need be. Only what lies between is encoded anew, once, so each character is encoded twice at most.
    """
    total, before = 0, 0
    open_text: list[str] | None = None
    for c, after in zip(chunks, [*chunks[1:], None]):
        if open_text is not None:
            open_text.append(c["head"])
            if c["first"] is None:
                continue
            total += len(starts_of(tokenizer(), "".join(open_text)))
            before, open_text = c["first"], None
        if after is None:
            total += c["tokens"] - before
            continue
        common = c["right"].keys() & after["left"].keys()
        if common:
            meeting = min(common)
            total += c["right"][meeting] - before
            before = after["left"][meeting]
        elif c["last"] is None:
            open_text = [c["head"]]
        else:
            total += c["last"] - before
            open_text = [c["tail"]]
    return total if open_text is None else total + len(starts_of(tokenizer(), "".join(open_text)))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None,
                 limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns `keep` (default: all) and n_bytes, n_tokens and over_limit (more than `limit` tokens).

    `tokenizer` is the JSON of a tokenizer that drops white space. Texts up to `chunk` characters are counted
    word by word. A longer text is cut into chunks which overlap their successors by `overlap` characters; the
    chunks are dealt to all tasks, encoded with offsets, and spliced at boundaries both neighbours found. Where
    an overlap has none, it is widened until there is one; the task of a document gets its boundaries and the words
    across such borders, and holds one of them at a time, which the library would encode as a whole. Null and empty texts have 0 bytes and 0 tokens;
    repeated rows stay; a column named like a result column must be renamed before.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    clash = set(keep) & {"n_bytes", "n_tokens", "over_limit"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    if not 0 < overlap < chunk:
        raise ValueError("an overlap must be shorter than its chunk")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kept = [f for f in source.schema if f.name != "text"]
    counted = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCounts(loaded(shared.value))
        for batch in batches:
            for part in blocks.split_rows(batch, "text", blocks.BLOCK_BYTES):
                texts = list(blocks.text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(list(map(len, texts)), pa.int64()),
                     pa.array(words.count(texts), pa.int64())], [*names, "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("text")[i].as_py()
                one = batch.slice(i, 1)
                for begin in range(0, len(content), chunk):
                    piece = content[begin:begin + chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [*(one.column(n) for n in names), pa.array([f"{split}-{row}"]),
                         pa.array([begin], pa.int64()), pa.array([len(piece[:chunk].encode())], pa.int64()),
                         pa.array([piece])], [*names, "row", "begin", "bytes", "piece"])
                row += 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                begin = batch.column("begin")[i].as_py()
                found = encode_chunk(model, batch.column("piece")[i].as_py(), begin, chunk, overlap)
                own = batch.slice(i, 1)
                sides = [pa.array([list(found[s].items())], pa.map_(pa.int64(), pa.int64())) for s in ("left", "right")]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(n) for n in [*names, "row", "begin", "bytes"]), *sides,
                     *(pa.array([found[c]], pa.int64()) for c in ("tokens", "first", "last")),
                     *(pa.array([found[c]], pa.string()) for c in ("head", "tail"))],
                    [*names, "row", "begin", "bytes", "left", "right", "tokens", "first", "last", "head", "tail"])

    def spliced(table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        chunks = table.select(["left", "right", "tokens", "first", "last", "head", "tail"]).to_pylist()
        for c in chunks:
            c["left"], c["right"] = dict(c["left"]), dict(c["right"])
        tokens = splice(lambda: loaded(shared.value), chunks)
        size = sum(table.column("bytes").to_pylist())
        return table.slice(0, 1).select(names).append_column("n_bytes", pa.array([size], pa.int64())).append_column(
            "n_tokens", pa.array([tokens], pa.int64()))

    cuts = T.StructType([*kept, *T._parse_datatype_string("row string, begin bigint, bytes bigint, piece string").fields])
    sides = T.StructType([*kept, *T._parse_datatype_string(
        "row string, begin bigint, bytes bigint, left map<bigint,bigint>, right map<bigint,bigint>, "
        "tokens bigint, first bigint, last bigint, head string, tail string").fields])
    huge = F.length("text") > chunk
    short = source.where(~huge).mapInArrow(whole, counted)
    pieces = source.where(huge).mapInArrow(cut, cuts).repartition("row", "begin").mapInArrow(coded, sides)
    long = pieces.groupBy("row").applyInArrow(spliced, counted)
    return short.unionByName(long).select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
