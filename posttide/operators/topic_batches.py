"""A topic model fitted batch by batch: online variational Bayes (Hoffman, Blei and Bach, 2010).

The fit does not depend on how rows are spread. Batches are runs of the documents in the order of a hash of their key,
a document's step sees that document and the model only, and what documents add to the model is summed in whole
numbers, whose sum has no order. The model, topics times vocabulary, is all that the driver and a task hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.operators.ranking import bucketed_row_number, shuffle_key
from posttide.operators.topics import PASSES, SEED, TOPICS
from posttide.session import scratch_path

# Settings of the fit.
BATCH, DECAY, OFFSET, LONGEST, CHANGE = 128, 0.7, 10.0, 100, 1e-3
#: Parts of one in what documents add to the model.
UNIT = float(1 << 32)
#: A folder of the written batches holds about as many documents, in this many files.
FOLDER_ROWS, FOLDER_FILES = 1 << 16, 8
#: Documents that a task works on at a time.
TOGETHER = 128
#: A folder with as many batches is worked through by one task; with fewer, large ones, each batch by many.
CHAIN = 16


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for x > 0: six steps up, then the asymptotic series."""
    x = np.asarray(x, float)
    # 1 / x + ... + 1 / (x + 5) by one division: the terms meet in pairs, the first with the last.
    y = x * (x + 5.0)
    low = (2.0 * x + 5.0) * ((3.0 * y + 20.0) * y + 24.0) / (y * (y + 4.0) * (y + 6.0))
    x = x + 6.0
    r = 1.0 / x
    w = r * r
    rest = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w * (1 / 132 - w * (691 / 32760))))))
    return np.log(x) - 0.5 * r - rest - low


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """exp E[log p] of Dirichlet rows."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True)))


def document_steps(counts: np.ndarray, sizes: np.ndarray, beta: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents with terms, a row each, and what they add to their terms' topics.

    Documents lie one after another, `sizes` counts the terms of each; `beta` has a row per topic and a column per term
    of a document. A document's numbers are the same whichever documents are beside it: it is multiplied as a matrix of
    its own, and stops at its own last round. The scale of `theta` cancels out in all that comes of it, so its
    logarithms are not normed.
    """
    ends = np.cumsum(sizes).tolist()
    places = [slice(b - n, b) for b, n in zip(ends, sizes.tolist())]
    own = [np.ascontiguousarray(beta[:, p]) for p in places]
    gamma = np.ones((len(sizes), len(beta)))
    theta, sums = np.exp(digamma(gamma)), np.empty_like(gamma)

    def laid(docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Counts, norms and shares of some documents one after another, and each one's part of these."""
        mine = np.concatenate([counts[places[d]] for d in docs]) if docs else counts
        norms, shares, parts, at = np.empty_like(mine), np.empty_like(mine), [], 0
        for d in docs:
            to = at + places[d].stop - places[d].start
            parts.append((theta[d], own[d], norms[at:to], shares[at:to], sums[d]))
            at = to
        return mine, norms, shares, parts

    every = laid(list(range(len(sizes))))
    (mine, norms, shares, parts), active = every, np.arange(len(sizes))
    for _ in range(LONGEST):
        for topics, matrix, norm, _, _ in parts:
            topics.dot(matrix, norm)
        norms += 1e-100
        np.divide(mine, norms, out=shares)
        for _, matrix, _, share, total in parts:
            matrix.dot(share, total)
        now = prior + theta[active] * sums[active]
        moving = np.abs(now - gamma[active]).sum(axis=1) / len(beta) >= CHANGE
        gamma[active], theta[active] = now, np.exp(digamma(now))
        if not moving.any():
            break
        if not moving.all():
            active, parts = active[moving], [part for part, moves in zip(parts, moving.tolist()) if moves]
            if 2 * sum(len(part[2]) for part in parts) <= len(mine):  # else the places of the others stay beside them
                mine, norms, shares, parts = laid(active.tolist())
    mine, norms, shares, parts = every
    for topics, matrix, norm, _, _ in parts:
        topics.dot(matrix, norm)
    norms += 1e-100
    gained = np.repeat(theta.T, sizes, axis=1)
    gained *= beta
    gained *= np.divide(mine, norms, out=shares)
    return gamma, gained


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, their counts, and the number of terms per document, some documents at a time."""
    for at in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(at, TOGETHER)
        places, values = part.column("places"), part.column("counts")
        yield (places.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float),
               pa.compute.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))


def _sparse(bags: DataFrame, features: str) -> list:
    vector = F.unwrap_udt(features)
    return [vector["indices"].alias("places"), vector["values"].alias("counts")]


@dataclass
class BatchTopics:
    """The fitted model: `weights` has a row per topic and a column per term."""

    weights: np.ndarray
    prior: float

    def topic_weights(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(topic, term, weight): share of each term in each topic; `terms` in the order of the bags."""
        shares = self.weights / self.weights.sum(axis=1, keepdims=True)
        rows = [(k, term, float(shares[k, i])) for k in range(len(shares)) for i, term in enumerate(terms)]
        return spark.createDataFrame(rows, "topic int, term string, weight double")

    def document_topics(self, bags: DataFrame, features: str = "features") -> DataFrame:
        """Add `topics`, the shares of a document's topics, which sum to 1."""
        shared, prior = bags.sparkSession.sparkContext.broadcast(expected_logs(self.weights)), self.prior
        kept = [c for c in bags.columns if c != features]
        names = [f"c{i}" for i in range(len(kept))]
        rows = bags.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], *_sparse(bags, features))
        schema = T.StructType([*rows.drop("places", "counts").schema,
                               T.StructField("topics", T.ArrayType(T.DoubleType()))])

        def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            beta = shared.value
            for batch in batches:
                found = []
                for places, counts, sizes in _bags(batch):
                    gamma = np.full((len(sizes), len(beta)), prior)
                    gamma[sizes > 0] = document_steps(counts, sizes[sizes > 0], beta[:, places], prior)[0]
                    found.extend(gamma)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names),
                     pa.array([(g / g.sum()).tolist() for g in found], pa.list_(pa.float64()))], [*names, "topics"])

        return rows.mapInArrow(infer, schema).select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "topics")


def _write_batches(bags: DataFrame, key: str, features: str, seed: int, batch: int) -> tuple[DataFrame, int]:
    """The bags with the number of their batch, written so that a batch reads its own folder only; and their count."""
    keyed = bags.select(key, *_sparse(bags, features)).withColumn("_key", shuffle_key([key], seed))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, 4))
    ranked = bucketed_row_number(keyed, [], ["_bucket"], [F.col("_key"), F.col(key)], "_rank")
    per_folder = max(1, FOLDER_ROWS // batch)
    placed = ranked.select(
        "places", "counts", F.expr(f"(_rank - 1) div {batch}").alias("batch"),
        F.expr(f"(_rank - 1) div {batch * per_folder}").alias("folder"), F.expr(f"_rank % {FOLDER_FILES}").alias("file"))
    path = scratch_path(bags.sparkSession, "topic-batches")
    (placed.repartition("folder", "file").sortWithinPartitions("folder", "batch")
     .write.partitionBy("folder", "file").parquet(path))
    written = bags.sparkSession.read.schema(placed.schema).parquet(path)
    return written, written.count()


def _add(sums: np.ndarray, part: pa.RecordBatch, beta: np.ndarray, prior: float) -> None:
    """Adds what the documents give to the terms' topics, in parts of `UNIT`."""
    for places, counts, sizes in _bags(part):
        gained = np.rint(document_steps(counts, sizes[sizes > 0], beta[:, places], prior)[1] * UNIT).astype(np.int64)
        for mine, given in zip(sums, gained):
            np.add.at(mine, places, given)


def _stepped(weights: np.ndarray, sums: np.ndarray, prior: float, step: int, size: int, total: int) -> np.ndarray:
    """The model after a batch of `size` documents out of `total`."""
    share = (OFFSET + step + 1) ** -DECAY
    return (1 - share) * weights + share * (prior + total / size * (sums / UNIT))


def _chained(rows: DataFrame, weights: np.ndarray, prior: float, done: int, batch: int, total: int) -> np.ndarray:
    """The model after the batches of one folder, which follow one another in one task: it holds the model and a few
    batches. `done` counts the steps of the passes before."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, number = shared.value, -1
        beta = sums = None

        def end() -> np.ndarray:
            return _stepped(weights, sums, prior, done + number, min(batch, total - number * batch), total)

        for part in parts:
            numbers = part.column("batch").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for at, to in zip(starts, starts[1:]):
                if to > at and numbers[at] != number:
                    if number >= 0:
                        weights = end()
                    number, beta, sums = int(numbers[at]), expected_logs(weights), np.zeros(weights.shape, np.int64)
                _add(sums, part.slice(at, to - at), beta, prior)
        yield pa.RecordBatch.from_arrays([pa.array([end().tobytes()], pa.binary())], ["weights"])

    # One stage: the files of the folder are read, sorted and worked through by the same task.
    ordered = rows.select("places", "counts", "batch").coalesce(1).sortWithinPartitions("batch")
    found = ordered.mapInArrow(work, "weights binary").collect()[0]["weights"]
    shared.destroy()
    return np.frombuffer(found).reshape(weights.shape)


def _spread(rows: DataFrame, weights: np.ndarray, prior: float, batch: int) -> np.ndarray:
    """What the documents of one batch add, worked out by many tasks."""
    spark, k = rows.sparkSession, len(weights)
    shared = spark.sparkContext.broadcast(expected_logs(weights))
    added = T.StructType([T.StructField("place", T.IntegerType()),
                          *(T.StructField(f"t{i}", T.LongType()) for i in range(k))])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shared.value.shape, np.int64)
        for part in parts:
            _add(sums, part, shared.value, prior)
        found = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(s[found]) for s in sums)],
                                         schema=pa.schema([("place", pa.int32()),
                                                           *((f"t{i}", pa.int64()) for i in range(len(sums)))]))

    summed = rows.select("places", "counts").mapInArrow(add, added)
    if batch > FOLDER_ROWS:  # what the tasks add is summed before it comes to the driver
        summed = summed.groupBy("place").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(k)])
    found = summed.toArrow()  # of each of a few tasks, or in all, a row per term of the vocabulary at most
    sums = np.zeros(weights.shape, np.int64)
    at = found.column("place").to_numpy()
    for i in range(k):
        np.add.at(sums[i], at, found.column(f"t{i}").to_numpy())
    shared.destroy()
    return sums


def fit_topics_in_batches(bags: DataFrame, key: str, n_terms: int, k: int = TOPICS, seed: int = SEED,
                          passes: int = PASSES, batch: int = BATCH, features: str = "features") -> BatchTopics:
    """Fit on count vectors over `n_terms` terms, `batch` documents at a time, `passes` times over all of them.

    `key` must be unique. Same rows, same model, however they are partitioned. Batches follow one another: where a
    folder of about 65,536 documents has many small ones, one task works through it, since a few documents are worked
    out sooner than a job is started for them; a large batch is a job, spread over many tasks. So small batches take
    their time one after another whatever the cluster; take larger ones for large corpora. Bags without a term count as
    documents and add nothing; without any document the model is what it starts from.
    """
    rows, total = _write_batches(bags, key, features, seed, batch)
    prior = 1.0 / k
    weights = np.random.RandomState(seed).gamma(100.0, 0.01, (k, n_terms))
    batches = -(-total // batch)
    per_folder = max(1, FOLDER_ROWS // batch)
    for done in range(0, passes * batches, batches or 1):
        for first in range(0, batches, per_folder):
            numbers = range(first, min(first + per_folder, batches))
            folder = rows.where(F.col("folder") == first // per_folder)
            if len(numbers) >= CHAIN:
                weights = _chained(folder, weights, prior, done, batch, total)
                continue
            for number in numbers:
                sums = _spread(folder.where(F.col("batch") == number), weights, prior, batch)
                weights = _stepped(weights, sums, prior, done + number, min(batch, total - number * batch), total)
    return BatchTopics(weights, prior)
