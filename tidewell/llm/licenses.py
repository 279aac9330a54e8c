"""License scans by patience alignment.

Words are runs of letters and digits, in lower case. A license counts as found where at least ``coverage`` of its template's words are
aligned, in order, with words of the text that lie close together. A find misses at most that share of the template, so one of
a few rare words of the template must be there; every place in the whole text where one of them stands gives a window, and windows
that meet are one. Of a window, only stretches are looked at that hold enough of the template's words near each other, in blocks of
four templates' lengths that overlap by the span of a find. A block is aligned by patience: words that occur once in it and once in
the template are anchors, the longest increasing subsequence of the anchors' places is kept, and the gaps between them are aligned
in the same way; a gap without anchors is matched from its ends and then by longest common subsequence. The part of the
alignment that matches most words within a find's span is aligned again in its own surroundings, as long as that matches more, and is the
find: whole or edited, its words, place and coverage are those of the alignment. What lies before and behind is looked at in the same way.

Patience is not bound to match as many words as could be. A find that matches all words which block and template have in common
can't be bettered; the others are held against an exact table, carried from word to word: of the alignments of each beginning of
the template that miss so many of its words, the latest start. Only where the table shows more words than patience has matched do
the table's finds count. So a word that matches far off hides nothing.

Edge cases: a null text or one without words has no finds; a license that stands twice is reported twice, unless the second
starts within a template's length of the first, where the better is kept; ids may be null or repeat, each row is scanned by
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship, table

#: Notices of well-known public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "all-rights-reserved": "All rights reserved.",
}
#: Words that ordinary prose is full of; they are the last to be looked for.
PLAIN = frozenset(b"a all an and any are as at be by for from in including is it no not of on or other that the this to under use version with work you your".split())
COVERAGE, STRETCH = 0.9, 1.5


def _alphabet() -> bytes:
    """Letters in lower case, digits and bytes of other scripts as they are, all else a space."""
    return bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


_ALPHABET = _alphabet()


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_ALPHABET).split()


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in order of the first, whose seconds increase: patience sorting with back pointers."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(places)
    for k, (_, y) in enumerate(places):
        p = bisect_left(tops, y)
        back[k] = piles[p - 1] if p else -1
        tops[p : p + 1], piles[p : p + 1] = [y], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(places[k])
        k = back[k]
    return out[::-1]


def _common(a: list[bytes], b: list[bytes], i: int, j: int) -> list[tuple[int, int]]:
    """A longest common subsequence by tables; one side is no longer than a template."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        for y in range(len(b) - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
    x = y = 0
    out = []
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def align(a: list[bytes], b: list[bytes], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Pairs of places, increasing in both, where ``a`` (the template) and ``b`` have equal words; i and j are added to them."""
    head: list[tuple[int, int]] = []
    while a and b and a[0] == b[0]:
        head.append((i, j))
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    tail: list[tuple[int, int]] = []
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        tail.append((i + len(a), j + len(b)))
    middle: list[tuple[int, int]] = []
    if a and b:
        once_a, once_b = Counter(a), Counter(b)
        at = {w: k for k, w in enumerate(b) if once_b[w] == 1}
        anchors = _increasing([(k, at[w]) for k, w in enumerate(a) if once_a[w] == 1 and w in at])
        if anchors:
            p = q = 0
            for x, y in [*anchors, (len(a), len(b))]:
                middle += align(a[p:x], b[q:y], i + p, j + q)
                if x < len(a):
                    middle.append((i + x, j + y))
                p, q = x + 1, y + 1
        else:
            middle = _common(a, b, i, j)
    return head + middle + tail[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.coverage = coverage
        self.sought: dict[bytes, list[str]] = defaultdict(list)
        for name, words in self.words.items():
            missing = len(words) - self.least(name)
            rare = sorted(set(words), key=lambda w: (w in PLAIN, words.count(w), -len(w), w))
            found = 0
            for w in rare:  # a find misses too few words to miss all of these
                if found > missing:
                    break
                self.sought[w].append(name)
                found += words.count(w)

    def least(self, name: str) -> int:
        return max(1, -int(-self.coverage * len(self.words[name]) // 1))

    def windows(self, words: list[bytes]) -> Iterator[tuple[str, int, int]]:
        """(license, start, end): the surroundings of sought words, those that meet as one."""
        places: dict[str, list[int]] = defaultdict(list)
        sought = self.sought
        for k, w in enumerate(words):
            if w in sought:
                for name in sought[w]:
                    places[name].append(k)
        for name, at in places.items():
            reach = int(STRETCH * len(self.words[name])) + 1
            i, j = at[0] - reach, at[0]
            for p in at:
                if p - reach > j + reach + 1:
                    yield name, max(0, i), j + reach + 1
                    i = p - reach
                j = p
            yield name, max(0, i), min(len(words), j + reach + 1)

    def stretches(self, name: str, words: list[bytes], i: int, j: int) -> Iterator[tuple[int, int]]:
        """Parts of a window outside which no find lies: as many words as a find spans hold enough of the template's, in any order."""
        room = Counter(self.words[name])
        reach, least = self.span(name), self.least(name)
        enough, start, end = 0, -1, -1
        for k in range(i, j):
            if (w := words[k]) in room:
                room[w] -= 1
                enough += room[w] >= 0
            if k - reach >= i and (w := words[k - reach]) in room:
                enough -= room[w] >= 0
                room[w] += 1
            if enough >= least:
                low = max(i, k - reach + 1)
                if start >= 0 and low > end:
                    yield start, end
                    start = -1
                start, end = low if start < 0 else start, k + 1
        if start >= 0:
            yield start, end

    def span(self, name: str) -> int:
        """Words of the text from the first of a find to its last, at most."""
        return -int(-STRETCH * len(self.words[name]) // 1)

    def exact(self, name: str, words: list[bytes], i: int, j: int) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, end): for each place in [i, j) where a find may end, the one that misses least, as late a start as can be."""
        template = self.words[name]
        size, reach = len(template), self.span(name)
        most = size - self.least(name)
        at: dict[bytes, list[int]] = defaultdict(list)
        for r in range(size - 1, -1, -1):
            at[template[r]].append(r)
        start = [[-1] * (most + 1) for _ in range(size + 1)]  # by words of the template that are behind, and by how many of these are missed
        for k in range(i, j):
            ended: set[int] = set()
            for r in at.get(words[k], ()):
                for d in range(min(r, most) + 1):
                    s = k if r == d else start[r][d]
                    if s < 0 or k - s >= reach:
                        continue
                    x, e = r + 1, d
                    while x <= size and e <= most and s > start[x][e]:
                        start[x][e] = s
                        if x == size:
                            ended.add(e)
                        x, e = x + 1, e + 1
            if ended:
                e = min(ended)
                yield (size - e) / size, start[size][e], k + 1

    def aligned(self, name: str, words: list[bytes], i: int, j: int) -> tuple[int, int, int]:
        """(words matched, first word, end) of the part of a patience alignment with [i, j) that matches most within a find's span."""
        template, reach = self.words[name], self.span(name)
        best: list[tuple[int, int]] = []
        while True:
            pairs = align(template, words[i:j], 0, i)
            run, p = best, 0
            for q, (_, y) in enumerate(pairs):
                while y - pairs[p][1] >= reach:
                    p += 1
                if q + 1 - p > len(run):
                    run = pairs[p : q + 1]
            if len(run) == len(best):
                break
            best = run
            i, j = max(i, best[-1][1] + 1 - reach), min(j, best[0][1] + reach)
        if not best:
            return 0, i, i
        end = best[0][1] + 1
        for x, _ in best[1:]:  # the same words, as near to the first as they stand
            end = words.index(template[x], end) + 1
        first = end - 1
        for x, _ in best[-2::-1]:  # and to the last
            first -= 1
            while words[first] != template[x]:
                first -= 1
        return len(best), first, end

    def block(self, name: str, words: list[bytes], i: int, j: int) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, end) of the finds in [i, j)."""
        template, reach = self.words[name], self.span(name)
        size = len(template)
        count, first, end = self.aligned(name, words, i, j)
        found = count >= self.least(name)
        hits: list[tuple[float, int, int]] = []
        if not found or count < (Counter(words[i:j]) & Counter(template)).total():
            hits = list(self.exact(name, words, i, j))
            found = found and all(h[0] <= count / size for h in hits if abs(h[1] - first) < size)
        if not found:
            yield from hits
            return
        yield from self.finds(name, words, i, first + reach - size)  # what starts a template's length before, or behind, is another find
        yield count / size, first, end
        yield from self.finds(name, words, first + size, j)

    def finds(self, name: str, words: list[bytes], i: int, j: int) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, end) of the finds in [i, j), a block after the other."""
        size, reach = 4 * len(self.words[name]), self.span(name)
        for a, b in self.stretches(name, words, i, j):
            for low in range(a, max(b - reach, a + 1), size - reach):
                yield from self.block(name, words, low, min(b, low + size))

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end) of each find, by place."""
        words = words_of(text)
        found: dict[str, list[tuple[float, int, int]]] = defaultdict(list)
        for name, i, j in self.windows(words):
            for hit in self.finds(name, words, i, j):
                if found[name] and hit[1] - found[name][-1][1] < len(self.words[name]):
                    found[name][-1] = max(found[name][-1], hit, key=lambda h: (h[0], h[1] - h[2]))
                else:
                    found[name].append(hit)
        return sorted(((name, *h) for name, hits in found.items() for h in hits), key=lambda h: (h[2], h[0]))


def _scanned(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            row, finds = [], []
            for k, text in enumerate(batch.column(1)):
                for f in scanner.scan(text.as_py() or ""):
                    row.append(k)
                    finds.append(f)
            cols = list(zip(*finds, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))], ["id", "license", "coverage", "first_word", "end_word"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, first_word, end_word): a row for each license found in a whole text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scanned(templates or TEMPLATES, coverage), f"id {kind}, license string, coverage double, first_word long, end_word long").withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
