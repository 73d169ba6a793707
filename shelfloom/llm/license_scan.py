"""License texts inside documents: winnowed fingerprints, then banded alignment.

A template's word k-grams are hashed and winnowed (the least of every ``window``
consecutive hashes is kept), and an inverted index leads from a fingerprint to
templates and places. Any shared run of ``k + window - 1`` words has a fingerprint
in common. A document's fingerprints pick (template, place) candidates; candidates
on nearly the same diagonal are one. Each is aligned with the words of the document
around that diagonal, in a band, by longest common subsequence; the share of the
template's words that match, and the span from the first to the last of them, are
reported when the share is large enough; a short notice must match as a whole.

The index is that of the template list, which is part of the code that is sent;
every document is scanned where it is, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow
from shelfloom.llm.license_texts import TEXTS
from shelfloom.llm.words import WordHashes, shingle_hashes

K, WINDOW, PERCENT = 3, 3, 80
#: A template of fewer words is a short notice, all of which must match.
SHORT = 8
_WORD = re.compile(r"\w+")

_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public license texts and notices. Parts that stand alone are templates of their own.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-permission": _ISC,
    "isc-disclaimer": _ISC_DISCLAIMER,
    "isc": f"{_ISC} {_ISC_DISCLAIMER}",
    "bsd-conditions": _BSD,
    "bsd-disclaimer": _BSD_DISCLAIMER,
    "bsd-2-clause": f"{_BSD} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    **TEXTS,
}


def words_of(text: str) -> list[str]:
    """Words of a text in lower case, one for each word of the text as it is."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of every window (the last one of equals); of all grams if they are fewer."""
    if len(grams) == 0:
        return np.empty(0, np.int64)
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(template: list[str], words: list[str], band: int) -> tuple[int, int, int]:
    """(words of the template matched, first, last word matched): longest common subsequence where |i - j| is within the band around the diagonal.

    ``words`` starts ``band`` words before the diagonal.
    """
    numbers = {w: i for i, w in enumerate(dict.fromkeys(template))}
    return _align(np.array([numbers[w] for w in template], np.int64), np.array([numbers.get(w, -1) for w in words], np.int64), band)


def _align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """``align`` of word numbers, a row of the band at a time; -1 is a word of no template."""
    width = 2 * band + 1
    words = np.concatenate([words, np.full(max(0, len(template) + width - len(words)), -1, np.int64)])
    columns = np.arange(width)
    score, first, last = np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)
    skipped = np.full(width, -1)
    for i, word in enumerate(template):
        same = words[i : i + width] == word  # column c is the place i + c in words; column c of the row before is the place before
        skipped[:-1] = score[1:]
        skip = ~same & (skipped > score)  # the template's word is skipped
        at = columns + skip
        best = np.where(skip, skipped, score + same)
        first, last = first[at], np.where(same, i + columns, last[at])
        first = np.where(same & (first < 0), i + columns, first)
        score = np.maximum.accumulate(best)  # the document's word is skipped
        own = np.maximum.accumulate(np.where(best == score, columns, 0))
        first, last = first[own], last[own]
    c = int(score.argmax())
    return int(score[c]), int(first[c]), int(last[c])


class Index:
    """Templates with their fingerprints."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, percent: int = PERCENT):
        self.k, self.window = k, window
        self.names, self.words = [], []
        self.numbers: dict[str, int] = {}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        hashes = WordHashes()
        for name, text in templates.items():
            words = words_of(text)
            if len(words) < k:
                continue
            grams = shingle_hashes(hashes.of(words), k)
            for p in winnow(grams, window):
                self.postings[int(grams[p])].append((len(self.names), int(p)))
            self.names.append(name)
            self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64))
        self.counts = [np.bincount(x, minlength=len(self.numbers)) for x in self.words]
        self.needs = [len(x) if len(x) < SHORT else -(-percent * len(x) // 100) for x in self.words]
        self.keys = np.array(sorted(self.postings), dtype=np.uint64)

    def possible(self, t: int, numbers: np.ndarray) -> bool:
        """Whether enough words of a template are in the words at all, in any order: no alignment has more."""
        have = np.bincount(numbers[numbers >= 0], minlength=len(self.numbers))
        return int(np.minimum(have, self.counts[t]).sum()) >= self.needs[t]

    def scan(self, text: str, hashes: WordHashes) -> list[tuple[str, int, int, int, int]]:
        """(template, matched words, template words, start, end) of a text, by place; of overlapping finds of one template the best."""
        words = words_of(text)
        if len(words) < self.k or not len(self.keys):
            return []
        grams = shingle_hashes(hashes.of(words), self.k)
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        if not (self.keys[at] == grams).any():
            return []
        places = winnow(grams, self.window)
        places = places[self.keys[at[places]] == grams[places]]
        diagonals: dict[int, set[int]] = defaultdict(set)
        for p in places:
            for t, q in self.postings[int(grams[p])]:
                diagonals[t].add(int(p) - q)
        numbers = np.array([self.numbers.get(w, -1) for w in words], np.int64) if diagonals else None
        found = []
        for t, starts in diagonals.items():
            template = self.words[t]
            if len(words) < self.needs[t] or not self.possible(t, numbers):
                continue
            band = max(2, len(template) // 8)
            best: list[tuple[int, int, int]] = []
            reach = None
            for d in sorted(starts):
                if reach is not None and d <= reach + band // 2:
                    continue  # the band of the diagonal before holds it
                reach = d
                lo = d - band
                around = numbers[max(0, lo) : max(0, d + len(template) + band)]
                if not self.possible(t, around):
                    continue
                around = np.concatenate([np.full(max(0, -lo), -1, np.int64), around])
                n, first, last = _align(template, around, band)
                if n >= self.needs[t]:
                    best.append((n, first + lo, last + lo))
            for n, first, last in sorted(best, key=lambda x: (-x[0], x[1])):
                if all(last < a or first > b for name, _, _, a, b in found if name == t):
                    found.append((t, n, len(template), first, last))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        out = [(self.names[t], n, size, spans[a][0], spans[b][1]) for t, n, size, a, b in found]
        return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` to (key, template, matched, words, coverage, start, end): a row for each find; offsets in code points, end exclusive.

    Texts without a find, null and empty texts give no row. Repeated rows give
    their finds again. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(templates, percent=percent), WordHashes()
        for part in arrow.parts(batches, 1_000):
            rows = [(k, name, n, size, n / size, a, b) for k, t in zip(*arrow.values(part, "key", "text"), strict=True) for name, n, size, a, b in index.scan(t, hashes)]
            yield arrow.made({n: ([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("key", "template", "matched", "words", "coverage", "start", "end"), types, strict=True))})

    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    out = rows.mapInArrow(run, "key bigint, template string, matched bigint, words bigint, coverage double, `start` bigint, `end` bigint")
    return out.withColumnRenamed("key", key)
