"""Blocks of documents that ask a distributed table about their distinct keys.

Several operators look up something for every word or window of every document.
One shuffled row per word would cost far more than the text itself, so documents
travel in blocks of a few megabytes:

    blocks    (block, payload)        packed documents, shuffled once by block
    asks      (part, block, ask)      what a block wants to know, split by a hash of the key
    answers   (block, part, answer)   worked out where all asks of one part meet
    assemble                          block and answers meet again and give the result rows

Blocks are of even size whatever a document, source or key weighs, a key is
asked for at most once per block, and the parts are dealt by hash, so no hot
group reaches one task. The exchange by block is used twice in one plan, and
Spark computes it once. A lost executor costs the recomputation of its own
splits: the name of a block is its input split and its place in it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
BLOCK_SCHEMA = "block string, payload binary"
ASK_SCHEMA = "part int, block string, ask binary"
ANSWER_SCHEMA = "block string, part int, answer binary"


def release() -> None:
    """Hands freed memory back to the machine. Worker processes live on for later stages, and what their allocators
    keep for themselves adds up from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        for value in chunk.cast(pa.large_binary()):
            yield value.as_py() or b""


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A long text cut at white space into pieces of about `size`, so that its word list stays small."""
    start, n = 0, len(text)
    while n - start > size:
        end = start + size
        while end < n and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def split_rows(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each; one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def split_array(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of a text column with about `size` bytes each; one text at least."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return (part.column("text") for part in split_rows(batch, "text", size))


def make_blocks(df: DataFrame, column: str, size: int = BLOCK_BYTES,
                prepare: Callable[[pa.Table], bytes] = pack, deal: bool = True) -> DataFrame:
    """Rows of `df` packed into blocks and, with `deal`, shuffled by block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = TaskContext.get().partitionId(), 0
        held, held_bytes = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()  # not kept beside the table
            row = prepare(table)
            return pa.RecordBatch.from_arrays([pa.array([f"{split}-{count}"]), pa.array([row], pa.binary())],
                                              ["block", "payload"])

        for batch in batches:
            for part in split_rows(batch, column, size):
                held.append(part)
                held_bytes += _text_size(part, column)
                if held_bytes >= size * 3 // 4:
                    yield flush()
                    count, held_bytes = count + 1, 0
        if held:
            yield flush()
        release()

    rows = df.mapInArrow(packed, BLOCK_SCHEMA)
    return rows.repartition("block") if deal else rows


def _text_size(batch: pa.RecordBatch, column: str) -> int:
    return (pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0) + 64 * batch.num_rows


def ask(blocks: DataFrame, fn: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """`fn` turns a payload into (part, ask) rows."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column("block"), batch.column("payload")):
                rows = list(fn(payload.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([name.as_py()] * len(rows)),
                         pa.array([r[1] for r in rows], pa.binary())], ["part", "block", "ask"])
        release()

    return blocks.mapInArrow(asked, ASK_SCHEMA)


def answer(asks: DataFrame, fn: Callable[[int, list[bytes]], list[bytes | None]], extra: str = "") -> DataFrame:
    """`fn` gets a part's number and all its asks, and gives one answer for each; None sends nothing. One answer
    more, if there is one, is addressed to `extra`."""

    def answered(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        replies = fn(part, table.column("ask").to_pylist())
        release()
        kept = [(b, r) for b, r in zip([*table.column("block").to_pylist(), extra], replies) if r is not None]
        return pa.table({"block": pa.array([k[0] for k in kept], pa.string()),
                         "part": pa.array([part] * len(kept), pa.int32()),
                         "answer": pa.array([k[1] for k in kept], pa.binary())})

    return asks.groupBy("part").applyInArrow(answered, ANSWER_SCHEMA)


def assemble(blocks: DataFrame, answers: DataFrame,
             fn: Callable[[bytes, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """`fn` gets a payload and its answers by part, and gives the result rows."""

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("part").to_pylist(), right.column("answer").to_pylist()))
        tables = [fn(payload, replies) for payload in left.column("payload").to_pylist()]
        release()
        return pa.concat_tables(tables) if tables else wanted.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    wanted = to_arrow_schema(struct)
    return (blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, struct))


def parts_for(df: DataFrame) -> int:
    """Into how many parts keys are dealt: as many as the session shuffles into."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
