"""Language identification by a bidirectional gated recurrent network over the bytes of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks
from posttide.operators.joins import lookup_join
from posttide.session import materialize

#: The fit takes at most this many documents of each language, at most this many bytes of each, and words of them.
SAMPLE = 150
SAMPLE_BYTES = 16 << 10
WORDS = 40_000
HIDDEN = 16
UNIT = 32
MEMORY = 200_000
UNKNOWN = "und"


def units(text: bytes) -> Iterator[list[bytes]]:
    """The sequences of a text: its words between ASCII white space, cut after UNIT bytes. The network starts
    anew with each, so equal words get equal labels and are worked out once."""
    for piece in blocks.pieces(text):
        words = piece.split()
        if any(len(w) > UNIT for w in words):
            words = [w[i:i + UNIT] for w in words for i in range(0, len(w), UNIT)]
        yield words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """A gated recurrent unit in each direction; every position gets probabilities of all languages."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, languages: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        weights = {"out": rng.normal(0, 0.3, (2 * h, languages)), "bias": np.zeros(languages)}
        for d in ("f", "b"):
            weights[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * h))
            weights[f"{d}h"] = rng.normal(0, 0.3, (h, 3 * h))
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def run(self, data: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction for a batch of sequences of one length, and what the way back needs."""
        n, length = data.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states, kept = np.empty((length, n, HIDDEN), np.float32), []
        steps = range(length) if d == "f" else range(length - 1, -1, -1)
        x, u = self.w[f"{d}x"], self.w[f"{d}h"]
        for t in steps:
            a = x[data[:, t]]
            b = h @ u
            gates = sigmoid(a[:, :2 * HIDDEN] + b[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = b[:, 2 * HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN:] + r * inner)
            kept.append((t, h, z, r, inner, c))
            h = c + z * (h - c)
            states[t] = h
        return states, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=-1, keepdims=True)

    def forward(self, data: np.ndarray) -> np.ndarray:
        """Probabilities by position, sequence and language."""
        return self.probabilities(np.concatenate([self.run(data, d)[0] for d in "fb"], axis=-1))

    def gradients(self, data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        runs = {d: self.run(data, d) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=-1)
        error = self.probabilities(states)
        error[:, np.arange(len(label)), label] -= 1
        error /= data.size
        found = {"out": np.einsum("tni,tnj->ij", states, error), "bias": error.sum(axis=(0, 1))}
        back = error @ self.w["out"].T
        for i, d in enumerate("fb"):
            u = self.w[f"{d}h"]
            to_x, to_h = np.zeros_like(self.w[f"{d}x"]), np.zeros_like(u)
            flow = np.zeros((len(label), HIDDEN), np.float32)
            for t, h, z, r, inner, c in reversed(runs[d][1]):
                flow = flow + back[t][:, i * HIDDEN:(i + 1) * HIDDEN]
                dz = flow * (h - c) * z * (1 - z)
                dc = flow * (1 - z) * (1 - c * c)
                dr = dc * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                db = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(to_x, data[:, t], da)
                to_h += h.T @ db
                flow = flow * z + db @ u.T
            found[f"{d}x"], found[f"{d}h"] = to_x, to_h
        return found


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places and their bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            data = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8)
            yield own, data.reshape(len(own), -1)


def train(words: list[bytes], labels: np.ndarray, languages: int, epochs: int = 5, batch: int = 256,
          rate: float = 0.01, seed: int = 7) -> Network:
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    groups, step = list(by_length(words)), 0
    for epoch in range(epochs):
        batches = []
        for own, data in groups:
            mixed = rng.permutation(len(own))
            batches += [(data[mixed[i:i + batch]], labels[own[mixed[i:i + batch]]]) for i in range(0, len(own), batch)]
        for i in rng.permutation(len(batches)):
            step += 1
            for k, g in net.gradients(*batches[i]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                net.w[k] -= (speed * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def smallest_hashes(rows: DataFrame, group: str, n: int) -> DataFrame:
    """At most `n` rows (group, h, ...) of each group with the smallest distinct hashes `h`.

    Counts of the different hashes of each group give a bound below which about four times as many hashes lie (all,
    in a group that has no more), so that the ranking gets a number of rows that does not grow with the input,
    however large a group is and however often its rows repeat.
    """
    different = rows.groupBy(group, "h").agg(F.lit(1).alias("_one"))
    counts = materialize(different.groupBy(group).agg(F.count("*").alias("_n")), "sample-counts")
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    near = lookup_join(rows, counts, [group], "inner").where(share * F.col("_n") < 4 * n).drop("_n").distinct()
    order = Window.partitionBy(group).orderBy(share, *rows.columns)
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def stretch(text: Column, h: Column, size: int) -> Column:
    """The text; of one with more than `size` bytes, the size // 4 characters from a place on that its hash names."""
    run = size // 4
    start = (F.pmod(h, F.char_length(text) - run + 1) + 1).cast("int")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.substring(text, start, F.lit(run)))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> dict:
    """Learned languages and weights. Uses only texts and non-null languages of documents for which `learn` holds:
    of each language at most SAMPLE documents, in the order of a hash of the text, of each its `stretch` of at most
    SAMPLE_BYTES bytes, and WORDS words in all. Null texts teach nothing. Without any such document nothing is
    learned."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    chosen = smallest_hashes(known.select("lang", "h"), "lang", SAMPLE).drop("n")
    rows = known.join(F.broadcast(chosen), ["lang", "h"]).select(
        "lang", "h", stretch(F.col("text"), F.col("h"), SAMPLE_BYTES).alias("text")).groupBy("lang", "h").agg(
        F.min("text").alias("text"))
    rows = rows.orderBy("lang", "h").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return {"languages": [], "weights": None}
    rng = np.random.default_rng(7)
    words, labels = [], []
    for i, language in enumerate(languages):
        found = [w for r in rows if r.lang == language for part in units(r.text.encode()) for w in part]
        if found:
            take = rng.permutation(len(found))[:max(1, WORDS // len(languages))]
            words += [found[j] for j in take]
            labels += [i] * len(take)
    if not words:
        return {"languages": languages, "weights": Network.fresh(len(languages)).w}
    return {"languages": languages, "weights": train(words, np.array(labels), len(languages)).w}


class Labeller:
    """Sums of probabilities over the positions of a word, kept for words seen before; emptied when large."""

    def __init__(self, model: dict):
        self.net, self.n = Network(model["weights"]), len(model["languages"])
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, self.n))

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > MEMORY:
            self.place, self.sums, new = {}, np.zeros((0, self.n)), words
        sums = np.zeros((len(new), self.n))
        for own, data in by_length(new):
            for i in range(0, len(own), 4096):
                sums[own[i:i + 4096]] = self.net.forward(data[i:i + 4096]).sum(axis=0)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.sums = np.concatenate([self.sums, sums])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text."""
        number = defaultdict(count().__next__)
        found = []
        for text in texts:
            codes = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in units(text)]
            found.append(np.concatenate(codes))
        words = list(number)
        self.learn(words)
        table = self.sums[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        total = np.array([table[c].sum(axis=0) for c in found]).reshape(len(texts), self.n)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), lang_pred and score, the pooled probability of that language.

    The network labels every byte position of a text; a document's probabilities are the means over all its
    positions. A null text, one without any letter, and every text where nothing was learned is `und` with score
    0. Ties go to the first language in order. Columns named like a result must be renamed before.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    clash = set(keep) & {"lang_pred", "score"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages = shared.value["languages"]
        labeller = Labeller(shared.value) if languages else None
        for batch in batches:
            names, scores = [], []
            for part in blocks.split_array(batch, blocks.PIECE_BYTES):
                texts = part.to_pylist()
                usable = [labeller is not None and has_letter(t) for t in texts]
                if labeller:
                    pooled = labeller.pooled([t.encode() if u else b"" for t, u in zip(texts, usable)])
                    best = pooled.argmax(axis=1)
                for i, u in enumerate(usable):
                    names.append(languages[best[i]] if u else UNKNOWN)
                    scores.append(min(float(pooled[i, best[i]]), 1.0) if u else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["lang_pred", "score"])
        labeller = None
        blocks.release()

    own = "_" * (1 + max(map(len, keep), default=0))  # a name that none of the kept columns has
    found = docs.select(*[F.col(f"`{c}`") for c in keep], labelled(F.col(f"`{text}`")).alias(own))
    return found.select(*[F.col(f"`{c}`") for c in keep], f"{own}.lang_pred", f"{own}.score")
