"""License scans: windows over the words of a text against licence templates by the Dice coefficient over word bigrams.

A text is lower-cased and reduced to words, across line breaks. A window reaches the threshold only if it shares enough
of a template's bigrams within a width that the size bound 2 * min(a, b) / (a + b) >= threshold allows, and the best
windows begin and end with a shared bigram: so the places of shared bigrams give all windows to compare. Of a template's
overlapping windows the best by Dice coefficient stays; of different templates' the one that shares most bigrams.
The templates are a fixed small list, so each worker holds them all.

Defined results: null and empty texts, and texts under two words, match nothing; ties go to the higher coefficient, then
to the earlier window, then to the licence first in alphabetical order; repeated rows are scanned each; an empty table
gives an empty result; extra columns are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
MATCH_SCHEMA = "doc_id long, license string, start int, end int, dice double"
SCHEMA = "doc_id long, license string, dice double, line int, n_matches int, matched string"

#: Licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bigrams(text: str) -> Counter:
    """Counts of adjacent word pairs of the normalised text."""
    words = WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Templates sorted by bigram count, for size-bounded comparison."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        rows = sorted(((grams.total(), name, grams) for name, texts in templates.items() for t in texts if (grams := bigrams(t))), key=lambda x: x[:2])
        self.sizes, self.rows, self.threshold = [r[0] for r in rows], rows, threshold
        self.ratio = threshold / (2 - threshold)  # the smaller size over the larger, at least
        self.least, self.most = (self.sizes[0] * self.ratio, self.sizes[-1] / self.ratio) if rows else (1, 0)
        self.words = {w for _, _, grams in rows for pair in grams for w in pair}
        self.having: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, grams) in enumerate(rows):
            for pair in grams:
                self.having.setdefault(pair, []).append(k)

    def best(self, text: str) -> tuple[float, str] | None:
        """(Dice coefficient, name) of the best template at or above the threshold."""
        words = WORD.findall(text.lower())
        n = len(words) - 1
        # a shared pair needs shared words: twice those bounds what the coefficient can reach
        if not self.least <= n <= self.most or sum(w in self.words for w in words) < self.ratio * n:
            return None
        grams = Counter(zip(words, words[1:]))
        found = None
        for k in range(bisect.bisect_left(self.sizes, n * self.ratio), bisect.bisect_right(self.sizes, n / self.ratio)):
            score = dice(grams, self.rows[k][2])
            if score >= self.threshold and (found is None or (-score, self.rows[k][1]) < (-found[0], found[1])):
                found = score, self.rows[k][1]
        return found

    def windows(self, grams: list[tuple[str, str]], hits: list[int], k: int) -> list[tuple[int, float, int, int]]:
        """(shared bigrams, Dice coefficient, first and last bigram) of template k's best windows, none overlapping.

        hits: places in order of the text's bigrams that the template has.
        """
        size, _, known = self.rows[k]
        # rounded outwards: the threshold itself is tested on each window
        need, most = max(1, math.ceil(size * self.ratio - 1e-9)), math.floor(size / self.ratio + 1e-9)
        found = []
        for i in range(len(hits) - need + 1):
            first = hits[i]
            if hits[i + need - 1] - first >= most:
                continue
            left, shared, best = dict(known), 0, None
            for last in hits[i : i + most]:
                if last - first >= most:
                    break
                if left[grams[last]]:
                    left[grams[last]] -= 1
                    shared += 1
                    score = 2 * shared / (size + last - first + 1)
                    if score >= self.threshold and (best is None or score > best[1]):
                        best = shared, score, first, last
            if best:
                found.append(best)
        return disjoint(sorted(found, key=lambda x: (-x[1], -x[0], x[2])), 2)

    def matches(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, Dice coefficient) of all matches in order of the text, in characters."""
        low = lowered(text or "")
        words = WORD.findall(low)
        grams = list(zip(words, words[1:]))
        hits: dict[int, list[int]] = {}
        for at, pair in enumerate(grams):
            if pair in self.having:
                for k in self.having[pair]:
                    hits.setdefault(k, []).append(at)
        found = [(*w, self.rows[k][1]) for k, places in hits.items() if len(places) >= self.sizes[k] * self.ratio - 1e-9 for w in self.windows(grams, places, k)]
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        kept = disjoint(sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])), 2)
        return sorted((spans[first][0], spans[last + 1][1], name, score) for _, score, first, last, name in kept)


def lowered(text: str) -> str:
    """Lower case, character by character where the length would change, so that places stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def disjoint(found: list[tuple], at: int) -> list[tuple]:
    """Of windows in order of preference, those that share no word with a preferred one; first and last bigram at `at`."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for x in found:
        # a bigram ends with the word after its place
        first, last = x[at], x[at + 1] + 1
        k = bisect.bisect_right(starts, last)
        if k and ends[k - 1] >= first:
            continue
        starts.insert(k, first)
        ends.insert(k, last)
        kept.append(x)
    return kept


def license_matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, start, end (characters, end exclusive) and dice of every match; one row of nulls for a text
    without any. A narrow map."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        names = [c.split(" ")[0] for c in MATCH_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = known.matches(text)
                rows += [(doc_id, name, start, end, round(score, 6)) for start, end, name, score in found] or [(doc_id, None, None, None, None)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCH_SCHEMA)


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, line, n_matches and matched (the passage) of every text; null where nothing matches.

    The best match by Dice coefficient, then by name. line, counted from 1, is where it starts. A narrow map.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = known.matches(text)
                start, end, name, score = min(found, key=lambda m: (-m[3], m[2], m[0]), default=(0, 0, None, None))
                rows.append((doc_id, name, round(score, 6), text.count("\n", 0, start) + 1, len(found), text[start:end]) if found else (doc_id, None, None, None, 0, None))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence match of every document."""
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
