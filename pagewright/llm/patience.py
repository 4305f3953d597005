"""License scans by patience alignment.

A text and a template are aligned on the words that each holds exactly once: in
the template's order their places in the text must rise, so the longest
increasing subsequence of the places is taken.  Between two such anchors the
gaps are aligned in the same way, after what agrees next to the anchors.  The
share of the template's words that found a place is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_COVERAGE = 0.8
SLACK = 2
ALIGNMENTS_HELD = 8192  # per worker and direction, of at most SLACK times a template's words each
SPAN = ("coverage", "first_word", "last_word")

# License notices.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software."),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
}

_KEPT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def scan_words(text: str) -> list[bytes]:
    """Runs of letters a-z, digits and non-ASCII, A-Z lower-cased."""
    return text.encode().lower().translate(_KEPT).split()


def rising(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(places)
    for i, x in enumerate(places):
        pile = bisect_left(tops, x)
        if pile:
            below[i] = piles[pile - 1]
        if pile == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[pile], piles[pile] = x, i
    out = []
    at = piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = below[at]
    return out[::-1]


def align(text: Sequence[bytes], template: Sequence[bytes]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        once = {x for x, n in theirs.items() if n == 1 and mine.get(x) == 1}
        if not once:
            continue
        where = {x: i for i, x in enumerate(text[a:b], a) if x in once}
        anchors = [(where[x], j) for j, x in enumerate(template[c:d], c) if x in once]
        chosen = [anchors[i] for i in rising([p for p, _ in anchors])]
        found += chosen
        edges = [(a - 1, c - 1), *chosen, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(found)


def around(words: Sequence[bytes], template: Sequence[bytes], p: int, j: int) -> tuple[float, int, int]:
    """Coverage of the template by the words around place ``p``, which holds its word ``j``, and the first and last word aligned."""
    low, high = max(0, p - SLACK * (j + 1)), p + 1 + SLACK * (len(template) - j)
    n_before, back = _reach_back(tuple(words[low:p]), tuple(template[:j]))
    n_after, on = _reach_on(tuple(words[p + 1 : high]), tuple(template[j + 1 :]))
    return (n_before + 1 + n_after) / len(template), p - back, p + on


# Notices are repeated, within a text and over texts: what stands around a word was often aligned before.

@lru_cache(ALIGNMENTS_HELD)
def _reach_back(words: tuple[bytes, ...], template: tuple[bytes, ...]) -> tuple[int, int]:
    """Number of words aligned and how far the first is from the end of ``words``."""
    pairs = align(words, template)
    return len(pairs), len(words) - pairs[0][0] if pairs else 0


@lru_cache(ALIGNMENTS_HELD)
def _reach_on(words: tuple[bytes, ...], template: tuple[bytes, ...]) -> tuple[int, int]:
    """Number of words aligned and how far the last is from the start of ``words``, counted from one."""
    pairs = align(words, template)
    return len(pairs), pairs[-1][0] + 1 if pairs else 0


class _Taken:
    """Stretches of a text of which none meets another."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, low: int, high: int) -> bool:
        at = bisect_left(self.spans, (high + 1,))
        return at == 0 or self.spans[at - 1][1] < low

    def add(self, low: int, high: int) -> None:
        insort(self.spans, (low, high))

    def give_back(self, low: int, high: int) -> None:
        del self.spans[bisect_left(self.spans, (low, high))]


def stretches(words: Sequence[bytes], places: Mapping[bytes, Sequence[int]], template: Sequence[bytes], least: float) -> list[tuple[float, int, int]]:
    """Coverage, first and last word of the stretches of a text that cover ``least`` of the template, best first, none meeting another.

    Stretches are aligned around each occurrence of the template words that the
    text holds least often, so that statements made twice do not hide each other.
    Of one word more than a stretch may lack, each stretch that counts holds one.
    Places with too few words of the template around them are not aligned; what
    is found is aligned again around all its words.
    """
    n = len(template)
    need = next(m for m in range(n + 1) if m / n >= least)
    offsets: dict[bytes, list[int]] = {}
    for j, x in enumerate(template):
        offsets.setdefault(x, []).append(j)
    rarest = sorted((len(places.get(x, ())), js[0], x) for x, js in offsets.items())[: n - need + 1]
    near = sorted(p for x in offsets for p in places.get(x, ()))
    hits: list[tuple[float, int, int]] = []
    whole = -1  # the last word of the last stretch that holds all of the template
    for p, x in sorted((p, x) for _, _, x in rarest for p in places.get(x, ())):
        for j in offsets[x] if p > whole else ():
            if bisect_left(near, p + 1 + SLACK * (n - j)) - bisect_left(near, p - SLACK * (j + 1)) < need:
                continue
            hit = around(words, template, p, j)
            if hit[0] >= least:
                hits.append(hit)
                whole = hit[2] if hit[0] == 1.0 else whole
    out: list[tuple[float, int, int]] = []
    taken = _Taken()
    for hit in sorted(hits, key=_rank):
        if taken.free(hit[1], hit[2]):
            out.append(hit)
            taken.add(hit[1], hit[2])
    for i, (coverage, low, high) in enumerate(out):
        if coverage < 1.0:
            again = [around(words, template, p, j) for p in range(low, high + 1) for j in offsets.get(words[p], ())]
            taken.give_back(low, high)
            out[i] = min([out[i], *(h for h in again if taken.free(h[1], h[2]))], key=_rank)
            taken.add(out[i][1], out[i][2])
    return sorted(out, key=_rank)


def _rank(hit: tuple[float, int, int]) -> tuple[float, int, int]:
    return -hit[0], hit[2] - hit[1], hit[1]


MATCHES = "doc_id long, licenses array<struct<license:string,coverage:double,first_word:long,last_word:long,stretches:array<struct<coverage:double,first_word:long,last_word:long>>>>"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id and the licenses found, best first, for every row of ``docs`` (doc_id, text).

    A license counts if at least ``least`` of its template's words are aligned.
    Its stretches are all places of the text where that is so, best first; its own
    coverage, first and last word are those of the best.
    Templates too few of whose words occur anywhere in a text cannot reach that and
    are not aligned.  Null, empty and clean texts have an empty list; repeated rows
    are scanned each; whole texts are read, one at a time; further columns are
    left out.  Ties go to the longer template, then to the name.
    """
    cut = {name: scan_words(t) for name, t in templates.items()}
    vocabulary = {x for words in cut.values() for x in words}

    def found_in(text: str) -> list[dict]:
        words = scan_words(text)
        present = vocabulary.intersection(words)
        names = [n for n, t in cut.items() if sum(x in present for x in t) >= least * len(t)]
        if not names:
            return []
        places: dict[bytes, list[int]] = {}
        for i, x in enumerate(words):
            if x in present:
                places.setdefault(x, []).append(i)
        found = [(name, [dict(zip(SPAN, h)) for h in stretches(words, places, cut[name], least)]) for name in names]
        hits = [{"license": name, **many[0], "stretches": many} for name, many in found if many]
        return sorted(hits, key=lambda h: (-h["coverage"], -len(cut[h["license"]]), h["license"]))

    span = [("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    license = pa.struct([("license", pa.string()), *span, ("stretches", pa.list_(pa.struct(span)))])
    schema = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(license))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [found_in(t.as_py()) if t.is_valid else [] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)
