"""Quality by compression: how much better a text compresses after good text than after bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks
from posttide.llm.language import smallest_hashes, stretch
from posttide.session import materialize

#: The fit takes at most this many labelled documents of each class, at most this many bytes of each.
SAMPLE = 800
SAMPLE_BYTES = 64 << 10
DICTIONARY = 32 << 10
LEVEL = 3
PIECE = 512


def cut(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of a class; with too little text to train on, the text itself."""
    samples = [p for t in texts for p in cut(t, 1024)]
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compression:
    """What compression says of a text: (bytes after the good dictionary - bytes after the bad one) / bytes of the
    text, and the logarithm of its compressed share, which tells repetition from prose. A text is compressed in
    pieces, each after the dictionary, so that all of a long text is held against both."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._prepared(d)) for d in (good, bad)]

    @staticmethod
    def _prepared(data: bytes) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=LEVEL)
        return made

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        pieces = cut(text, PIECE)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return (good - bad) / len(text), float(np.log(good / len(text)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[float]]:
    """Intercept and slopes of P(y=1) = 1 / (1 + exp(-(intercept + x . slopes))), by Newton steps with a small
    ridge on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 0.1 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return float(beta[0] - slopes @ mean), slopes.tolist()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text") -> dict:
    """A model of `labels.quality` (doc_id, quality 0 or 1; other values and nulls are ignored).

    Takes at most SAMPLE documents of each class, in the order of a hash of the text, of each its `stretch` of at
    most SAMPLE_BYTES bytes; every second one goes into the dictionaries, the others calibrate the score. The shares of the classes
    are counted over all labelled documents.
    """
    marked = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = docs.where(learn).select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = known.withColumn("h", F.xxhash64("text", "doc_id"))
    found = materialize(known.select("doc_id", "h").join(marked, "doc_id").select("quality", "h", "doc_id"), "labelled")
    shares = dict(found.groupBy("quality").count().collect())
    chosen = smallest_hashes(found, "quality", SAMPLE)
    rows = (known.join(F.broadcast(chosen), ["doc_id", "h"]).select(
                "quality", "n", stretch(F.col("text"), F.col("h"), SAMPLE_BYTES).alias("text"))
            .groupBy("quality", "n").agg(F.min("text").alias("text")).orderBy("quality", "n").collect())
    by_class = {q: [r.text.encode() for r in rows if r.quality == q] for q in (0, 1)}
    total = sum(shares.values())
    if not by_class[0] or not by_class[1]:
        return {"constant": shares.get(1, 0) / total if total else 0.5}
    learnt, tried = ({q: (t[k::2] or t) for q, t in by_class.items()} for k in (0, 1))
    model = {"good": dictionary(learnt[1]), "bad": dictionary(learnt[0])}
    compression = Compression(**model)
    x = np.array([compression(t) for q in (0, 1) for t in tried[q]])
    y = np.repeat([0.0, 1.0], [len(tried[0]), len(tried[1])])
    weight = np.where(y == 1, shares[1] / len(tried[1]), shares[0] / len(tried[0])) * len(y) / total
    model["intercept"], model["slopes"] = fit_logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and score, the probability of label 1.

    A null text is an empty text; its score is what the model says of no difference. A model that saw only one
    class gives every text the share of label 1, without any label 0.5. A column named score must be renamed.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    if "score" in keep:
        raise ValueError("rename the column 'score'")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        compression = None if "constant" in fitted else Compression(fitted["good"], fitted["bad"])
        for batch in batches:
            texts = blocks.text_bytes(batch.column("text"))
            if compression is None:
                values = np.full(batch.num_rows, float(fitted["constant"]))
            else:
                found = np.array([compression(t) for t in texts]).reshape(-1, 2)
                logits = fitted["intercept"] + found @ np.array(fitted["slopes"])
                values = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.float64())],
                                             [*names, "score"])

    schema = T.StructType([*(f for f in source.schema if f.name != "text"), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(scored, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "score")
