"""Licence texts and notices in documents, by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import column_type, slices

# Public licence texts and notices, each paragraph a template of its own.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)

_WORD = re.compile(r"\w+")
_COPYRIGHT = re.compile(r"^\W*(?:copyright\b|\(c\)|©).*$", re.IGNORECASE | re.MULTILINE)
_PARAGRAPHS = re.compile(r"\n[^\S\n]*\n")


def bigrams(text: str) -> Counter:
    """Multiset of the word bigrams of the normalised text: lower-cased words, copyright lines left out."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Templates by number of bigrams; for a text only those of fitting size that share a bigram are compared."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        found = [(name, at, bigrams(text)) for at, (name, text) in enumerate(templates)]
        self.entries = sorted((x for x in found if x[2]), key=lambda x: (x[2].total(), x[1]))
        self.sizes = [x[2].total() for x in self.entries]
        self.words = {w for x in self.entries for pair in x[2] for w in pair}
        self.least, self.widest = least, (2 - least) / least
        self.by_bigram: dict[tuple, list[int]] = {}
        for n, (_, _, grams) in enumerate(self.entries):
            for gram in grams:
                self.by_bigram.setdefault(gram, []).append(n)

    def fits(self, bigram_count: int) -> tuple[int, int]:
        """The templates ``from, to`` whose size allows the least coefficient with so many bigrams."""
        low = bisect_left(self.sizes, bigram_count / self.widest - 1e-9)
        return low, bisect_right(self.sizes, bigram_count * self.widest + 1e-9)

    def best(self, text: str) -> tuple[str, int, float] | None:
        """Name, number and coefficient of the most similar template, if it is similar enough."""
        words = _WORD.findall(text.lower())
        low, high = self.fits(len(words) - 1)
        # beyond what the least coefficient allows, foreign words can't be made up for
        if low >= high or 2 * sum(w in self.words for w in words) < self.least * len(words):
            return None
        grams = Counter(zip(words, words[1:], strict=False))
        hit = {n for gram in grams for n in self.by_bigram.get(gram, ()) if low <= n < high}
        scored = [(dice(grams, self.entries[n][2]), -self.entries[n][1], n) for n in hit]
        score, _, n = max(scored, default=(0.0, 0, 0))
        return (self.entries[n][0], self.entries[n][1], score) if score >= self.least else None

    def scan(self, text: str | None) -> list[tuple[str, int, str, int, float]]:
        """``licence, template, unit, at, dice`` of the text, its paragraphs and lines, the best of each template."""
        text = _COPYRIGHT.sub("", text or "")
        units = [("text", 0, text)]
        paragraphs = _PARAGRAPHS.split(text)
        if len(paragraphs) > 1:
            units += [("paragraph", n, p) for n, p in enumerate(paragraphs)]
        lines = text.split("\n")
        if len(lines) > 1:
            units += [("line", n, line) for n, line in enumerate(lines)]
        best: dict[int, tuple] = {}
        for unit, at, part in units:
            found = self.best(part) if part else None
            if found and found[2] > best.get(found[1], (0, 0, 0, 0, 0.0))[4]:
                best[found[1]] = (found[0], found[1], unit, at, found[2])
        return [best[k] for k in sorted(best)]


def scan_licences(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = 0.8,
) -> DataFrame:
    """``id, licence, template, unit, at, dice``: a row for each template that a document holds.

    The whole text, each paragraph and each line are units. A unit is normalised
    (copyright lines out, lower case, words only) and compared by the Dice
    coefficient of its word bigrams, as multisets. With a least coefficient ``t``
    only templates of ``t / (2 - t)`` to ``(2 - t) / t`` times its bigrams can
    reach it; the others are never looked at. Of each template the unit with the
    largest coefficient is given, the first of equal ones.

    Null and empty texts have no units with bigrams and give no row. Repeated
    rows give repeated results, null ids stay null; an empty table gives none.
    Nothing is shuffled. Further columns of the input are ignored.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64())
        for part in slices(batches):
            rows, found = [], []
            for n, text in enumerate(part.column(1).to_pylist()):
                own = known.scan(text)
                found += own
                rows += [n] * len(own)
            columns = list(zip(*found, strict=True)) or [[]] * 5
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            keys = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *arrays], ["_id", "licence", "template", "unit", "at", "dice"])

    kind = column_type(documents, id_column)
    return (
        documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        .mapInArrow(scanned, f"_id {kind}, licence string, template int, unit string, at long, dice double")
        .withColumnRenamed("_id", id_column)
    )
