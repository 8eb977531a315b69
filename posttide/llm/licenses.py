"""License scans: passages held against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide.llm import blocks

LEAST = 0.8
#: Public licence notices, as they stand at the head of files.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT-notice": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "all-rights-reserved": "All rights reserved.",
}
#: Lower-case letters, digits, bytes above ASCII and line ends stay; other bytes separate words.
FOLD = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256)).lower()


def lines_of(text: bytes) -> list[list[bytes]]:
    """The words of each line in normal form."""
    return [line.split() for line in text.translate(FOLD).split(b"\n")]


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    """Templates by bigram. The words of templates are numbered, so a text's bigrams are looked up in one table."""

    def __init__(self, templates: dict[str, str], least: float):
        self.names = sorted(n for n in templates if len(self._words(templates[n])) > 1)
        self.grams = [bigrams(self._words(templates[n])) for n in self.names]
        self.least = least
        words = sorted({w for g in self.grams for pair in g for w in pair})
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.width = len(words) + 1
        codes = sorted({self._code(*pair) for g in self.grams for pair in g})
        self.known = np.full(self.width * self.width, -1)
        self.known[codes] = np.arange(len(codes))
        self.often = np.zeros((len(codes), len(self.names)), np.int64)
        for t, gram in enumerate(self.grams):
            for pair, n in gram.items():
                self.often[self.known[self._code(*pair)], t] = n
        self.bounds = [(g.total() * least / (2 - least), g.total() * (2 - least) / least) for g in self.grams]
        self.needed = np.array([least * (low + g.total()) / 2 for (low, _), g in zip(self.bounds, self.grams)])

    def _code(self, a: bytes, b: bytes) -> int:
        return self.number[a] * self.width + self.number[b]

    @staticmethod
    def _words(text: str) -> list[bytes]:
        return text.encode().translate(FOLD).replace(b"\n", b" ").split()

    def candidates(self, text: bytes) -> list[int]:
        """Templates of whose bigrams the text has as many as the smallest passage that could match would share."""
        get, before, seen = self.number.get, 0, np.zeros(len(self.often), bool)
        for piece in blocks.pieces(text.translate(FOLD)):
            words = piece.split()
            codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            codes = np.concatenate(([before], codes))
            found = self.known[codes[:-1] * self.width + codes[1:]]
            seen[found[found >= 0]] = True
            before = codes[-1]
        return np.flatnonzero(self.often[seen].sum(axis=0) + 1e-9 >= self.needed).tolist() if seen.any() else []

    def scan(self, text: bytes) -> Iterator[tuple[str, float, int, int]]:
        """(template, coefficient, first line, last line) of the best passage for each template: a run of whole
        lines whose first and last line share a word with it. Ties go to the earlier, then shorter passage."""
        possible = self.candidates(text)
        lines = lines_of(text) if possible else []
        for t in possible:
            name, gram = self.names[t], self.grams[t]
            # Shared bigrams are at most the smaller size, which bounds the size of a passage both ways.
            low, high = self.bounds[t]
            vocabulary = {w for pair in gram for w in pair}
            touched = [i for i, words in enumerate(lines) if not vocabulary.isdisjoint(words)]
            best = None
            for k, first in enumerate(touched):
                words, at = [], first
                for last in touched[k:]:
                    while at <= last and len(words) - 1 <= high:
                        words = words + lines[at]
                        at += 1
                    if len(words) - 1 > high:
                        break
                    if len(words) - 1 < low:
                        continue
                    found = dice(bigrams(words), gram)
                    if found >= self.least and (best is None or found > best[1]):
                        best = (name, found, first, last)
            if best:
                yield best

    def spans(self, text: bytes) -> Iterator[tuple[str, float, int, int, int, int]]:
        """(template, coefficient, first word, last word, first line, last line) of the best run of words for each
        template, wherever lines end. The best run begins and ends with shared bigrams: others at its ends only
        lower the coefficient. Ties go to the earlier, then shorter run."""
        possible = self.candidates(text)
        if not possible:
            return
        lines = lines_of(text)
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
        get = self.number.get
        codes = np.fromiter((get(w, 0) for words in lines for w in words), np.int64, int(ends[-1]))
        found = self.known[codes[:-1] * self.width + codes[1:]]
        for t in possible:
            often, total = self.often[:, t], self.grams[t].total()
            low, high = self.bounds[t]
            at = np.flatnonzero((found >= 0) & (often[found] > 0))
            after = np.searchsorted(at, at + (high + 1e-9), side="left")
            enough = np.flatnonzero(after - np.arange(len(at)) + 1e-9 >= self.needed[t])
            places, grams, allowed, best = at.tolist(), found[at].tolist(), often.tolist(), None
            for k in enough.tolist():
                left, shared, first = {}, 0, places[k]
                for m in range(k, after[k]):
                    g = grams[m]
                    rest = left.get(g, allowed[g])
                    if rest:
                        left[g] = rest - 1
                        shared += 1
                    size = places[m] - first + 1
                    if size + 1e-9 < low:
                        continue
                    dice = 2 * shared / (size + total)
                    if dice >= self.least and (best is None or dice > best[0]):
                        best = (dice, first, places[m] + 1)
                if best and best[0] == 1:
                    break
            if best:
                yield (self.names[t], *best, *np.searchsorted(ends, best[1:], side="right").tolist())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text",
                  keep: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """Rows for every document and licence template that a passage of the document matches: the columns `keep`
    (default: all), license, dice, first_line and last_line (from 0).

    Words are compared in lower case (A-Z) without punctuation. A passage is a run of whole lines; those outside
    the size bounds that the least coefficient implies are never compared. Null, empty and one-word texts match
    nothing, nor do templates of fewer than two words; repeated rows are found each. Every text is scanned whole
    in its own task; templates are a parameter of bounded size.
    """
    return _scanned(docs, templates, text, keep, least, ["first_line", "last_line"], Scanner.scan)


def scan_license_spans(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text",
                       keep: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """Like `scan_licenses`, but a passage is any run of words, also inside a line or across lines: the columns
    `keep`, license, dice, first_word and last_word (of all words of the text in normal form, from 0), first_line and
    last_line."""
    return _scanned(docs, templates, text, keep, least, ["first_word", "last_word", "first_line", "last_line"],
                    Scanner.spans)


def _scanned(docs: DataFrame, templates: dict[str, str] | None, text: str, keep: list[str] | None, least: float,
             places: list[str], scan: Callable[[Scanner, bytes], Iterator[tuple]]) -> DataFrame:
    keep = list(docs.columns) if keep is None else list(keep)
    result = ["license", "dice", *places]
    clash = set(keep) & set(result)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((templates if templates is not None else TEMPLATES, least))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in batches:
            rows = [(i, *found) for i, t in enumerate(blocks.text_bytes(batch.column("text"))) for found in scan(scanner, t)]
            if rows:
                own = batch.take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(n) for n in names), pa.array([r[1] for r in rows]),
                     pa.array([r[2] for r in rows], pa.float64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3, 3 + len(places)))],
                    [*names, *result])

    schema = T.StructType([*(f for f in source.schema if f.name != "text"), T.StructField("license", T.StringType()),
                           T.StructField("dice", T.DoubleType()), *(T.StructField(p, T.LongType()) for p in places)])
    return source.mapInArrow(scanned, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *result)
