"""Token ids in binary files that open at any document.

A file is a stream of token ids (unsigned 32-bit, little-endian) in the public seekable format of zstandard:

    frame ... frame        independent frames of some ten thousand ids, each decompressed by itself
    skippable frame        the documents of the file in order: id, number of token ids (a packed Arrow table)
    skippable frame        the seek table: compressed and decompressed size and checksum of every frame above

Any zstandard reader gets all ids of a file; a reader of some documents reads both tables at the end, then only the
frames that these documents touch, and verifies the checksum of each (the low half of XXH64).
"""

from __future__ import annotations

import array
import codecs
import json
import os
import re
import string
import struct
import uuid
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posttide.llm import blocks

# Fixed values of the public seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: Magic number of the skippable frame that holds the list of documents.
DOCUMENTS_MAGIC = 0x184D2A5D

#: A frame ends with the document that fills it, or within a document of more than four times as many ids.
FRAME_IDS = 1 << 14
#: A file ends with the document that reaches one of these.
FILE_IDS = 1 << 26
FILE_DOCUMENTS = 1 << 20
#: Text of one sorted range of documents.
RANGE_BYTES = 64 << 20
#: Words whose ids a task remembers, and the longest such word in bytes.
REMEMBERED = 5 << 17
LONGEST = 64
#: Words that are encoded as one text.
JOINED = 512
#: Rows that go to Python at once while files are written, and bytes of text whose words are looked up together.
ROWS_AT_ONCE = 1000
TEXT_AT_ONCE = 1 << 21
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Marks that often end a word, and what they must follow to be taken off: letters and digits that stay such when they
#: are normalised and lower-cased, as the letter U+0130 does not.
MARKS = string.punctuation.encode()
ALPHANUMERIC = (string.digits + string.ascii_letters).encode()
LATIN = frozenset(chr(c).encode() for c in range(0xC0, 0x180) if chr(c).isalpha() and c != 0x130)
#: Texts of such letters alone. Normalised, each letter is what `str.lower` makes of it.
PLAIN = re.compile("[A-Za-z " + "".join(sorted(c.decode() for c in LATIN)) + "]+")
# Fixed value: a public pattern of pre-tokens.
LETTERS_DIGITS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
INDEX_SCHEMA = "doc_id bigint, name string, at bigint, n_tokens bigint"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """Writes one file to an open binary stream; `add` takes a document's ids as pieces of bytes."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS, level: int = 3):
        self.out, self.frame_bytes, self.file_ids = out, 4 * frame_ids, file_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.held, self.held_bytes = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.ids = 0

    def _frame(self, size: int) -> None:
        data = b"".join(self.held)
        self.held, self.held_bytes = ([data[size:]] if len(data) > size else []), max(0, len(data) - size)
        data = data[:size]
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), checksum(data)))

    def add(self, doc_id: int | None, pieces: Iterable[bytes]) -> None:
        size = 0
        for piece in pieces:
            size += len(piece)
            for start in range(0, len(piece), self.frame_bytes):
                self.held.append(piece[start:start + self.frame_bytes])
                self.held_bytes += len(self.held[-1])
                if self.held_bytes > 4 * self.frame_bytes:
                    self._frame(4 * self.frame_bytes)
        if self.held_bytes >= self.frame_bytes:
            self._frame(self.held_bytes)
        self.doc_ids.append(doc_id)
        self.lengths.append(size // 4)
        self.ids += size // 4

    def full(self) -> bool:
        return self.ids >= self.file_ids or len(self.lengths) >= FILE_DOCUMENTS

    def close(self) -> None:
        if self.held_bytes:
            self._frame(self.held_bytes)
        listed = blocks.pack(pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()),
                                       "n_tokens": pa.array(self.lengths, pa.int64())}))
        self.out.write(struct.pack("<II", DOCUMENTS_MAGIC, len(listed)) + listed)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FileReader:
    """Reads documents of one file, given as an open stream that can seek, and its size."""

    def __init__(self, source, size: int):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a file of token ids: no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sums = table[:, 0], table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.ends = np.cumsum(table[:, 1])
        self.before = self.ends - table[:, 1]
        self.last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("a file of token ids is cut off")
        return data

    def documents(self) -> pa.Table:
        """doc_id and n_tokens of all documents, in order."""
        place = int(self.starts[-1])
        magic, size = struct.unpack("<II", self._at(place, 8))
        if magic != DOCUMENTS_MAGIC:
            raise ValueError("a file of token ids has no list of documents")
        return blocks.unpack(self._at(place + 8, size))

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed = self._at(int(self.starts[i]), int(self.packed[i]))
            size = int(self.ends[i] - self.before[i])
            data = self.unpacker.decompress(packed, max_output_size=size)
            if len(data) != size or checksum(data) != self.sums[i]:
                raise ValueError(f"frame {i} of a file of token ids is damaged")
            self.last = (i, data)
            self.frames_read += 1
        return self.last[1]

    def ids(self, at: int, n: int) -> bytes:
        """The `n` ids from place `at` on, as bytes."""
        a, b, parts = 4 * at, 4 * (at + n), []
        i = int(np.searchsorted(self.ends, a, side="right"))
        while a < b:
            start, data = int(self.before[i]), self.frame(i)
            parts.append(data[a - start:b - start])
            a, i = start + len(data), i + 1
        return b"".join(parts)


class ShortWay:
    """A tokenizer, and beside it one of the same merges that only parts texts at blanks: it gives words of plain letters
    the same ids for half the work, as such words are one pre-token each and need no patterns."""

    def __init__(self, model: str):
        import tokenizers
        from tokenizers.pre_tokenizers import ByteLevel

        def made(found: str) -> tokenizers.Tokenizer:
            tokenizer = tokenizers.Tokenizer.from_str(found)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return tokenizer

        self.whole, self.short = made(model), None
        if parts_plain_words(model):
            lean = {**json.loads(model), "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.short = made(json.dumps(lean))
            level = ByteLevel(add_prefix_space=False, use_regex=False)
            spelled = {b: c for x in LATIN for b, c in zip(x, level.pre_tokenize_str(x.decode())[0][0])}
            self.spelled = "".join(spelled.get(b, chr(b)) for b in range(256))

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list:
        if self.short is None or not all(map(PLAIN.fullmatch, texts)):
            return self.whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)
        plain = [codecs.charmap_decode(t.lower().encode(), "strict", self.spelled)[0] for t in texts]
        return self.short.encode_batch_fast(plain, add_special_tokens=False)


class WordIds:
    """Encodes texts by their words (runs without ASCII white space), for tokenizers that give white space no token.
    The ids of short words are remembered as bytes, up to a fixed number of words: when half of them are new since the
    last time, those that did not occur since then are forgotten."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.tokenizer = ShortWay(model)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.cut = cuts_before_marks(model)
        self.ends = ends_of_words(model, self.tokenizer.whole)
        self.lowers = lowers_letters(model)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def encoded_together(self, words: list[bytes]) -> list[bytes]:
        """The same; words of letters alone are encoded as one text, a blank between them. Each of them gives one
        pre-token or more, so where there are as many pre-tokens as words, the ends of the pre-tokens part the words."""
        text = b" ".join(words).decode("utf-8", "replace")
        if self.ends is None or not text.replace(" ", "").isalpha():
            return self.encoded(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        if len(ends) != len(words) or ends[-1:] != [len(data)]:
            return self.encoded(words)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: Collection[bytes]) -> dict[bytes, bytes]:
        """The ids of all the words. Words with marks at their end are put together from those without."""
        self.make_room()
        known = self.known
        new = (words if isinstance(words, set) else set(words)).difference(known)
        if not new:
            return known
        self.recall(new)
        plain, letters, other, long, stems, parts = [], [], [], [], {}, set()
        for word in new:
            if len(word) > LONGEST:
                long.append(word)
            elif word.isalpha():
                plain.append(word)
            else:
                stem = word.rstrip(MARKS) if self.cut else word
                if len(stem) != len(word) and stem and b"<" not in word and (
                        stem[-1] in ALPHANUMERIC or stem[-2:] in LATIN):
                    stems[word] = stem
                    parts.add(stem)
                    parts.add(word[len(stem):])
                else:
                    other.append(word)
        parts = parts.difference(known, new)
        self.recall(parts)
        rest, other = [*parts, *other], []
        for word in rest:
            if word.isalpha():
                plain.append(word)
            elif word.isascii():
                other.append(word)
            else:
                text = word.decode("utf-8", "replace")
                (plain if PLAIN.fullmatch(text) else letters if text.isalpha() else other).append(word)
        for some, encoded, size in ((plain, self.encoded_together, JOINED), (letters, self.encoded_together, JOINED),
                                    (other, self.encoded, 4096)):
            for start in range(0, len(some), size):
                part = some[start:start + size]
                known.update(zip(part, encoded(part)))
        for word, stem in stems.items():
            known[word] = known[stem] + known[word[len(stem):]]
        return {**{w: known[w] for w in words if w in known}, **dict(zip(long, self.encoded(long)))} if long else known

    def recall(self, words: set[bytes]) -> None:
        """Takes what is remembered from before out of the words."""
        before = self.before
        found = {w: before[w] for w in words if w in before} if before else {}
        self.known.update(found)
        words.difference_update(found)

    def make_room(self) -> None:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.before = {}, self.known

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; those not met before are learned."""
        self.make_room()
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if not new:
            return found
        known = self.learn(new)
        return [known[w] if ids is None else ids for w, ids in zip(words, found)]

    def lowered(self, text: bytes) -> bytes:
        """A text, A-Z in lower case where the model does the same to them. Not so in a text with "<", which may begin
        an added token, or with a mark U+0300 to U+037F, which may combine with the letter before it."""
        plain = self.lowers and b"<" not in text and b"\xcc" not in text and b"\xcd" not in text
        return text.lower() if plain else text

    def words(self, text: bytes) -> list[bytes]:
        return self.lowered(text).split()

    def together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some megabytes of texts. Arrow parts them into words and finds the different ones, which are looked
        up once; the ids of all words then lie one after another."""
        cut = pc.ascii_split_whitespace(pa.array(map(self.lowered, texts), pa.binary()).view(pa.string()))
        coded = cut.values.dictionary_encode()
        names = coded.dictionary.view(pa.binary())
        # No word has a blank, so the list of them is read out as one text.
        listed = pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), b" ")[0].as_py().split(b" ")
        found = pa.array(self.ids(listed), pa.large_binary()).take(coded.indices)
        _, ends, data = found.buffers()
        data = memoryview(data or b"")
        ends = np.frombuffer(ends, np.int64, len(found) + 1)[cut.offsets.to_numpy()].tolist()
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def pieces(self, text: bytes) -> Iterator[bytes]:
        for piece in blocks.pieces(text):
            yield from self.together([piece])

    def each(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        """The pieces of every text. New words of short texts are learned at once."""
        short = [text for text in texts if len(text) <= blocks.PIECE_BYTES]
        found = iter(self.together(short) if short else [])
        for text in texts:
            yield self.pieces(text) if len(text) > blocks.PIECE_BYTES else iter([next(found)])


def cuts_before_marks(model: str) -> bool:
    """Whether a mark of `MARKS` after a letter or digit always begins a new pre-token, so that a word is encoded as
    what stands before its last marks, then the marks: so with this pattern of pre-tokens."""
    found = (json.loads(model).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return found[0].get("pattern") == {"Regex": LETTERS_DIGITS_OR_MARKS} and found[0].get("behavior") == "Removed"


def lowers_letters(model: str) -> bool:
    """Whether A-Z may be lower-cased before a text is encoded: the model does the same to all of a text but added
    tokens, which have a "<", after steps that leave A-Z as it is unless a mark follows."""
    found = json.loads(model)
    steps = (found.get("normalizer") or {}).get("normalizers") or []
    kept = all(s.get("type") == "NFC" or s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and
               s.get("content") == " " for s in steps[:-1])
    return bool(steps) and kept and steps[-1].get("type") == "Lowercase" and all(
        t["content"].startswith("<") and not t["single_word"] for t in found.get("added_tokens") or [])


def parts_plain_words(model: str) -> bool:
    """Whether a word of plain letters is one pre-token, written in the letters of its bytes after it is lower-cased."""
    steps = (json.loads(model).get("pre_tokenizer") or {}).get("pretokenizers") or []
    level = steps[1] if len(steps) == 2 else {}
    return (cuts_before_marks(model) and steps[0].get("invert") is True and lowers_letters(model) and
            level.get("type") == "ByteLevel" and not level.get("use_regex", True) and not level.get("add_prefix_space", True))


def ends_of_words(model: str, tokenizer) -> np.ndarray | None:
    """Of every id, whether it ends a pre-token; None where the ids do not tell. They do if the model writes a mark at
    the end of pre-tokens and knows every byte with the mark and without, so that no byte is left out."""
    from tokenizers.pre_tokenizers import ByteLevel

    its = json.loads(model).get("model") or {}
    mark = its.get("end_of_word_suffix")
    if its.get("type") != "BPE" or not mark or its.get("dropout") or its.get("ignore_merges"):
        return None
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    if not cuts_before_marks(model) or any(c not in vocab or c + mark not in vocab for c in ByteLevel.alphabet()):
        return None
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for name, i in vocab.items() if name.endswith(mark)]] = True
    return ends


def drops_white_space(model: str) -> bool:
    """Whether words can be encoded one by one: checked on the tokenizer itself, over every ASCII white space."""
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_str(model)

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    word = ids("word") + ids("Other")
    return all(ids(f"{a}word{a}{b}Other{b}") == word for a in " \t\n\x0b\x0c\r" for b in " \t\n\x0b\x0c\r")


#: The words that a worker process remembers from task to task, for one model.
_remembered: dict[str, WordIds] = {}


def words_of(model: str) -> WordIds:
    if model not in _remembered:
        _remembered.clear()
        _remembered[model] = WordIds(model)
    return _remembered[model]


def forget_words() -> None:
    _remembered.clear()
    blocks.release()


def encoder(model: str) -> Callable[[list[bytes]], Iterator[Iterator[bytes]]]:
    """Encodes a list of texts, each to pieces of id bytes."""
    by_word = drops_white_space(model)

    def encode(texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        words = words_of(model)
        yield from words.each(texts) if by_word else (iter(words.encoded([text])) for text in texts)

    return encode


def store_of(spark: SparkSession, path: str) -> str:
    """The folder as a full address, so that every task finds the same one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", found))


def write_token_files(docs: DataFrame, path: str, model: str, end_id: int, text: str = "text",
                      doc_id: str = "doc_id", frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes `text` with a model of the tokenizers library (its JSON; no special tokens added, those spelled out in a
    text handled as its default), ends each document with `end_id` and writes the ids in ascending order of
    `doc_id` to files in the folder `path`. Gives one row per file: part and number (its place in the order),
    name, n_docs, n_tokens.

    Null ids come first; rows with one id are ordered by a hash of their text, equal rows in any order. Null and
    empty texts have the end id alone. Other columns are left out, whatever their names. An empty table gives no
    files. Documents are dealt in ranges of id, hash and row, so that an id with very many rows is split too; a range is
    one task, which streams its rows into files of bounded size. A file is named by the attempt that wrote it and
    counts only if listed in the table `path`/files, so attempts that failed leave nothing that is read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + F.lit(64))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "h", "row"]
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    store, encode, end = store_of(spark, path) + "/data", encoder(model), struct.pack("<I", end_id)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, folder = fs.FileSystem.from_uri(store)
        out, writer, number = None, None, 0

        def ended() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([name(number)]),
                 pa.array([len(writer.lengths)], pa.int64()), pa.array([writer.ids], pa.int64())],
                ["part", "number", "name", "n_docs", "n_tokens"])

        def name(n: int) -> str:
            return f"{part:07d}-{n:05d}-{attempt}.zst"

        for batch in batches:
            for some in blocks.split_rows(batch, "text", TEXT_AT_ONCE):
                texts = list(blocks.text_bytes(some.column("text")))
                for key, pieces in zip(some.column("doc_id").to_pylist(), encode(texts)):
                    if writer is None:
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/{name(number)}", compression=None)
                        writer = FileWriter(out, frame_ids, file_ids)
                    writer.add(key, _then(pieces, end))
                    if writer.full():
                        yield ended()
                        writer, number = None, number + 1
        if writer is not None:
            yield ended()
        blocks.release()

    files = rows.select("doc_id", "text").mapInArrow(
        written, "part bigint, number bigint, name string, n_docs bigint, n_tokens bigint")
    most = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, min(int(most), ROWS_AT_ONCE) if int(most) > 0 else ROWS_AT_ONCE)
    try:
        files.write.parquet(f"{path}/files")
    finally:
        spark.conf.set(BATCH_KEY, most)
    return spark.read.parquet(f"{path}/files")


def _then(pieces: Iterator[bytes], end: bytes) -> Iterator[bytes]:
    yield from pieces
    yield end


def placed_files(spark: SparkSession, path: str) -> DataFrame:
    """name and file_start, the ids of all files before it, of every file in `path`, a task each."""
    files = spark.read.parquet(f"{path}/files")
    # One row per file of some 200 MB: few enough for one task.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    return placed.repartition(max(1, files.count()))


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files in `path`: doc_id, name of its file, place in it, n_tokens and start, the ids of
    all documents before it. Only the tables at the ends of the files are read."""
    store = store_of(spark, path) + "/data"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(store)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("file_start").to_pylist()):
                with opened(system, f"{folder}/{name}") as reader:
                    yield from index_of(reader, name, first)

    return placed_files(spark, path).mapInArrow(listed, f"{INDEX_SCHEMA}, start bigint")


def index_of(reader: FileReader, name: str, first: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, as `list_documents` gives them."""
    table = reader.documents().combine_chunks()
    lengths = table.column("n_tokens").to_numpy()
    at = np.cumsum(lengths) - lengths
    for i in range(0, len(at), 1 << 16):
        part = table.slice(i, 1 << 16).combine_chunks()
        own = at[i:i + (1 << 16)]
        yield from pa.table({"doc_id": part.column("doc_id"), "name": pa.array([name] * len(own), pa.string()),
                             "at": own, "n_tokens": lengths[i:i + (1 << 16)], "start": own + first}).to_batches()


class opened:
    """A reader of a file, closed at the end."""

    def __init__(self, system: fs.FileSystem, place: str):
        self.stream = system.open_input_file(place)
        self.reader = FileReader(self.stream, self.stream.size())

    def __enter__(self) -> FileReader:
        return self.reader

    def __exit__(self, *what) -> None:
        self.stream.close()


def read_token_files(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The documents of the files in `path`, or only those whose doc_id occurs in the first column of `wanted`:
    doc_id, start, n_tokens and ids (binary, 4 bytes each, little-endian). Only the frames these documents touch
    are read and decompressed, each verified by its checksum."""
    store = store_of(spark, path) + "/data"
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def taken(reader: FileReader, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The documents that the rows name, of one file, some megabytes at a time."""
        at, sizes = rows.column("at").to_numpy(), rows.column("n_tokens").to_numpy()
        found, held, first = [], 0, 0
        for i in range(rows.num_rows):
            found.append(reader.ids(int(at[i]), int(sizes[i])))
            held += len(found[-1])
            if held >= blocks.PIECE_BYTES or i + 1 == rows.num_rows:
                part = rows.slice(first, len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("start"), part.column("n_tokens"),
                     pa.array(found, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                found, held, first = [], 0, i + 1

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        system, folder = fs.FileSystem.from_uri(store)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("file_start").to_pylist()):
                with opened(system, f"{folder}/{name}") as reader:
                    for rows in index_of(reader, name, first):
                        yield from taken(reader, rows)

    def read_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(store)
        name, file = None, None
        for batch in batches:
            names = batch.column("name").to_pylist()
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)]):
                if names[a:b] and names[a] != name:
                    if file is not None:
                        file.__exit__()
                    name, file = names[a], opened(system, f"{folder}/{names[a]}")
                yield from taken(file.reader, batch.slice(a, b - a))
        if file is not None:
            file.__exit__()

    if wanted is None:
        # Listed and read in one step: two would keep twice as many worker processes.
        return placed_files(spark, path).mapInArrow(read_all, schema)
    keys = wanted.select(F.col(wanted.columns[0]).cast("bigint").alias("doc_id")).distinct()
    rows = list_documents(spark, path).join(keys, "doc_id", "left_semi")
    return rows.repartition("name").sortWithinPartitions("name", "at").mapInArrow(read_some, schema)
