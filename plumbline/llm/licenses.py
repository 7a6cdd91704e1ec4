"""License scan: fingerprints of two words, an inverted index, banded alignment.

Templates are license notices as sequences of lower-case words. Every two
neighbouring words of a template are a fingerprint in an inverted index of
(template, position). A document's neighbouring words look up candidates; hits
of one template on near diagonals are one candidate, and a banded local
alignment around them gives matched coverage and the span.
A best alignment of two or more words has two matched words side by side, as
every gap costs what a word brings; so with all runs of two in the
index none is missed (a template of one word is looked up by that word). Neither half of an
alignment is worth less than nothing, so it drifts by less than half the
template at once, which is the band. A stretch of text without enough of a
template's words, in any order, is not aligned.

The index is as large as the templates, which `most_words` bounds, and travels
with the function. Documents are scanned row by row as whole texts; nothing is
shuffled.

Defined results: null and empty texts have no matches; a document has a row for
every match, none without one; overlapping matches of one template give the one
of highest coverage, then the first; of overlapping matches of different licenses
those of lower coverage go, equal ones stay; an SPDX line counts only if all its
words match; repeated rows get equal results; an empty table gives no rows. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, raw_texts
from plumbline.llm.decontamination import fold
from plumbline.session import ship

ship(__name__)

#: Words of a fingerprint.
GRAM = 2
#: Least words that an alignment may drift from its diagonals.
BAND = 8
#: Least share of a template's words that a match must cover.
COVERAGE = 0.8
MOST_WORDS = 100_000

# Wording of public license notices, as (name, license, text).
TEMPLATES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("rights-reserved-line", "all-rights-reserved", "All rights reserved."),
    ("apache-2.0-grant", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0-header", "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1-line", "LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1-header", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-line", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0-header", "LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0-line", "AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0-header", "AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((f"cc-{kind.lower()}-{version}-line", f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.")
      for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "2.5", "3.0", "4.0") if (kind, version) != ("BY-NC", "4.0")),
    ("cc0-1.0-line", "CC0-1.0", "Licensed under CC0 1.0 Universal."),
    *((f"spdx-{name.lower()}", name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
        "AGPL-3.0-only AGPL-3.0-or-later GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense BSL-1.0 EPL-2.0 0BSD Zlib").split()),
)

_WORD = re.compile(rb"[^ ]+")


class Index:
    """Inverted index of the templates' neighbouring words."""

    def __init__(self, templates=TEMPLATES, most_words: int = MOST_WORDS):
        self.templates, self.words, self.vocabulary = list(templates), [], {}
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.single: dict[int, list[int]] = {}           # templates of one word
        for _, _, text in self.templates:
            self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in fold(text.encode()).split()])
        if sum(map(len, self.words)) > most_words:
            raise ValueError(f"templates of more than {most_words} words: scan with them in blocks")
        self.bands = [max(BAND, (len(ids) + 1) // 2) for ids in self.words]
        self.counts = [Counter(ids) for ids in self.words]
        for number, ids in enumerate(self.words):
            if len(ids) == 1:
                self.single.setdefault(ids[0], []).append(number)
            for at, (one, next_) in enumerate(zip(ids, ids[1:])):
                self.postings.setdefault(one * len(self.vocabulary) + next_, []).append((number, at))
        self.pairs = np.array(sorted(self.postings), dtype=np.int64)

    def candidates(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, least diagonal, greatest diagonal); the diagonal is the
        position in the document less that in the template."""
        known = np.array([self.vocabulary.get(w, -1) for w in words], dtype=np.int64)
        hits: dict[int, list[int]] = {}
        for word, templates in self.single.items():
            if len(at := np.flatnonzero(known == word)):
                hits.update((template, at.tolist()) for template in templates)
        if len(known) >= GRAM:
            both = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0))
            keys = known[both] * len(self.vocabulary) + known[both + 1]
            shared = np.isin(keys, self.pairs)
            for at, key in zip(both[shared].tolist(), keys[shared].tolist()):
                for template, position in self.postings[key]:
                    hits.setdefault(template, []).append(at - position)
        out = []
        for template, diagonals in hits.items():
            diagonals.sort()
            low = high = diagonals[0]
            for d in diagonals[1:]:
                if d - high > self.bands[template]:
                    out.append((template, low, high))
                    low = d
                high = d
            out.append((template, low, high))
        return out

    def aligned(self, words: list[bytes], template: int, low: int, high: int, least: float) -> list[tuple[int, int, int]]:
        """The alignments near the diagonals with at least `least` matched words:
        the best one, then those before and after it."""
        out, length, band = [], len(self.words[template]), self.bands[template]
        wanted, get = self.counts[template], self.vocabulary.get
        todo = [(max(0, low - band), min(len(words), high + length + band))]
        while todo:
            first, last = todo.pop()
            if last - first < least:
                continue
            there = Counter(map(get, words[first:last]))
            if sum(min(n, there[word]) for word, n in wanted.items()) < least:
                continue
            matched, start, end = self.align(words, template, low, high, first, last)
            if matched >= least:
                out.append((matched, start, end))
            if matched:
                todo += [(first, start), (end, last)]
        return out

    def align(self, words: list[bytes], template: int, low: int, high: int, first: int, last: int) -> tuple[int, int, int]:
        """Matched words, first and last + 1 word of the best local alignment
        (match 1, mismatch and gap -1) within words first to last."""
        wanted = self.words[template]
        get = self.vocabulary.get
        text = [get(w, -1) for w in words[first:last]]
        band = self.bands[template]
        width = high - low + 2 * band + 1
        shift = low - band - first                       # column c of row t stands for text[t + shift + c]
        empty = (0, 0, -1)
        above = [empty] * (width + 1)
        best = (0, 0, 0, 0)
        for t, word in enumerate(wanted):
            row = [empty] * (width + 1)
            left = empty
            for c in range(width):
                d = t + shift + c
                if not 0 <= d < len(text):
                    left = empty
                    continue
                score, matched, start = above[c]
                if text[d] == word:
                    cell = (score + 1, matched + 1, start if score > 0 else d)
                else:
                    cell = (score - 1, matched, start)
                for other in (above[c + 1], left):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, other[1], other[2])
                if cell[0] <= 0:
                    cell = empty
                row[c] = left = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], d + 1)
            above = row
        return best[1], first + best[2], first + best[3]

    def matches(self, words: list[bytes], coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first word, last word + 1) of the matches."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for template, low, high in self.candidates(words):
            share = 1.0 if self.templates[template][0].startswith("spdx-") else coverage
            found.setdefault(template, []).extend(self.aligned(words, template, low, high, max(1.0, share * len(self.words[template]) - 1e-9)))
        out = []
        for template, options in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            for matched, start, end in sorted(options, key=lambda o: (-o[0], o[1])):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    out.append((template, matched, start, end))
        return [m for m in out if not any(self._worse(m, other) for other in out)]

    def _worse(self, match: tuple[int, int, int, int], other: tuple[int, int, int, int]) -> bool:
        """Whether `other` overlaps the match, names another license and covers more
        of its template by no fewer words."""
        a, b = match[0], other[0]
        return (self.templates[a][1] != self.templates[b][1] and other[2] < match[3] and match[2] < other[3] and other[1] >= match[1]
                and (other[1] * len(self.words[a]), other[1]) > (match[1] * len(self.words[b]), match[1]))


def scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per match: license, template, share of the template's words that
    match, span in words and in characters."""
    index = Index(templates, most_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                folded = fold(raw)
                words = folded.split()
                found = index.matches(words, coverage)
                if found:
                    spans = [m.span() for m in _WORD.finditer(folded)]
                    for template, matched, start, end in found:
                        name, license_, _ = index.templates[template]
                        total = len(index.words[template])
                        at, to = len(raw[:spans[start][0]].decode()), len(raw[:spans[end - 1][1]].decode())
                        rows.append((doc_id, license_, name, matched / total, matched, total, start, end, at, to))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.int64(), pa.int64())
                names = ["doc_id", "license", "template", "coverage", "matched_words", "template_words", "start_word", "end_word", "start_char", "end_char"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, license string, template string, coverage double, matched_words int, template_words int, start_word int, end_word int, start_char long, end_char long"
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
