"""Near-duplicates by SimHash: an inverted index of byte positions, count filtering, and connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks
from posttide.llm.components import components
from posttide.operators.joins import lookup_join
from posttide.session import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: A fingerprint has 8 bytes; with at most 3 differing bits at least 5 of them are equal.
LEAST_BYTES = 8 - MAX_BITS
#: Sets of four positions whose numbers cancel out under XOR: whichever 3 bytes differ, one set avoids them all.
SETS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Index lists longer than this are split further before their members are compared.
LONG_LIST = 4096
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word runs of a text, piece by piece; a text with fewer words is one run."""
    tail: list[bytes] = []
    found = False
    digest = xxhash.xxh64_intdigest
    for piece in blocks.pieces(text.lower()):
        words = tail + piece.split()
        n = len(words) - size + 1
        if n > 0:
            found = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:n - 1])).tolist()
            values = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]
            yield np.array(values, np.uint64)
            tail = words[len(words) - size + 1:]
        else:
            tail = words
    if not found and tail:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set. Eight one-byte counters share a number while at most
    255 hashes are added up."""
    rows = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    rows[:len(hashes)] = hashes
    rows = rows.reshape(-1, 255)
    counts = np.zeros(64, np.int64)
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and `fp`."""
    keep = docs.columns if keep is None else list(keep)
    if "fp" in keep:
        raise ValueError("rename the column 'fp'")

    @F.arrow_udf(T.LongType())
    def marked(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in blocks.text_bytes(texts)], pa.int64())

    return docs.select(*[F.col(f"`{c}`") for c in keep], marked(F.col(f"`{text}`")).alias("fp"))


def byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def index_entries(fps: DataFrame) -> DataFrame:
    """Every fingerprint under each of its 14 keys: the number of a set of positions and the bytes there."""
    keys = []
    for number, positions in enumerate(SETS):
        key = F.lit(number).cast("bigint")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def refined(entries: DataFrame) -> DataFrame:
    """Entries of long lists under longer keys: a link has a fifth equal byte, and of its other 24 bits, in six
    runs of four, three runs at least are equal. What is left of a key's list has at most 2^12 fingerprints."""
    by_set = []
    for number, positions in enumerate(SETS):
        rest = [p for p in range(8) if p not in positions]
        options = []
        for fifth in rest:
            others = [8 * p + 4 * half for p in rest if p != fifth for half in (0, 1)]
            for runs in combinations(others, 3):
                nibbles = [F.shiftrightunsigned("fp", r).bitwiseAND(15) for r in runs]
                options.append(F.xxhash64("key", F.lit(fifth), byte(fifth), F.lit(str(runs)), *nibbles))
        by_set.append(F.when(F.shiftright("key", 32) == number, F.array(*options)))
    return entries.select("fp", F.explode(F.coalesce(*by_set)).alias("key"))


class Forest:
    """Disjoint sets over positions, joined many pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all members of one list which are at most `max_bits` apart, one fewer than the members
    of a connected group. Each pair of a list tallies its equal bytes; pairs below the guaranteed number drop
    out, the others are verified bit by bit. Keys are sorted."""
    n = len(keys)
    forest = Forest(n)
    ends = np.searchsorted(keys, keys, side="right")
    active, step = np.arange(n), 1
    while True:
        active = active[active + step < ends[active]]
        if not len(active):
            break
        x = fps[active] ^ fps[active + step]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = active[(tally >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        forest.join(near, near + step)
        step += 1
    everyone = np.arange(n)
    roots = forest.roots(everyone)
    tied = roots != everyone
    return fps[tied], fps[roots[tied]]


def links_in_lists(entries: DataFrame) -> DataFrame:
    """Links (a, b) within the lists of an index. Rows of one list stream through one task in order; only the
    list at hand is held."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def row(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            whole = np.searchsorted(keys, keys[-1])
            yield row(*linked(keys[:whole], fps[:whole]))
            keys, fps = keys[whole:], fps[whole:]
        yield row(*linked(keys, fps))

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(walked, "a bigint, b bigint").distinct()


def near_links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links between different fingerprints (column fp, distinct) at most 3 bits apart, enough to connect every
    pair of them that is linked. Long lists, as groups of very many near copies give them, are split by longer
    keys and never meet in one task."""
    entries = index_entries(fps)
    long = materialize(entries.groupBy("key").count().where(F.col("count") > long_list).select("key"), "long-lists")
    if long.isEmpty():
        return links_in_lists(entries)
    short = entries.join(long, "key", "left_anti")
    split = refined(entries.join(long, "key", "left_semi"))
    return links_in_lists(short.select("fp", "key").unionByName(split))


def group_near_duplicates(marked: DataFrame, doc_id: str = "doc_id", long_list: int = LONG_LIST,
                          links: DataFrame | None = None) -> DataFrame:
    """Rows of `marked`, a written table with the columns `doc_id` and `fp`, with root, a name of the component, and
    component_id: the smallest id among all rows whose fingerprints are connected by steps of at most 3 differing
    bits, or by `links` (a, b). Rows with equal fingerprints belong together; a component without any id has a null
    component_id."""
    fps = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "fingerprints")
    links = near_links(fps.select("fp"), long_list) if links is None else links
    tied = components(links).withColumnRenamed("node", "fp")
    rooted = fps.join(tied, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(smallest, "root"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    A text is lower-cased (A-Z), cut into words at ASCII white space and hashed by its runs of three words,
    repeats included; a shorter text is one run. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Repeated rows stay repeated rows.
    """
    marked = materialize(with_fingerprint(docs, text, [doc_id]), "simhash")
    found = group_near_duplicates(marked, doc_id)
    return found.select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                       mark: Callable[[DataFrame, str, list[str]], DataFrame] = with_fingerprint,
                       links: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest id stays (null ids
    last; of several such rows the one with the smallest hash of all its columns, of equal rows one).

    Rows are known by that 128-bit hash, so texts are neither written nor, while the rows that stay are few enough
    to be broadcast, shuffled. Only rows that repeat in all columns are brought together, to keep one of them.
    Another rule comes as `mark`, which adds `fp` and more, and `links`, made from the marked and the given rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    told = [F.coalesce(F.col(n).cast("string"), F.lit("\0null")) for n in names]
    keyed = source.withColumn("key", F.struct(F.xxhash64(*told), F.xxhash64(F.lit("second"), *told)))
    marked = materialize(mark(keyed, at[text], ["key", at[doc_id]]).withColumnRenamed(at[doc_id], "id"), "simhash")
    tied = links(marked, keyed, at[text]) if links else None
    grouped = group_near_duplicates(marked.select("key", "id", "fp"), "id", links=tied)
    grouped = grouped.groupBy("root", "id", "key").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "key", "n")
    first = grouped.groupBy("root").agg(F.min(order).alias("o")).select("o.key", "o.n")
    stays = materialize(first.select(F.col("key.col1").alias("k1"), F.col("key.col2").alias("k2"), "n"), "one-per-group")
    rows = keyed.select(*names, F.col("key.col1").alias("k1"), F.col("key.col2").alias("k2"))
    single = lookup_join(rows, stays.where("n = 1").drop("n"), ["k1", "k2"], "left_semi", salts=1)
    several = lookup_join(rows, stays.where("n > 1").drop("n"), ["k1", "k2"], "left_semi", salts=1)
    kept = single.unionByName(several.dropDuplicates(["k1", "k2"]))
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
