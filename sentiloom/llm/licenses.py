"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

1. A template is a sequence of normalised words (lower case, letters and digits only).  Hashes of its runs of ``GRAM`` words are winnowed: of each ``WINDOW``
   neighbouring hashes the least one is kept, so any shared run of ``GRAM + WINDOW - 1`` words shares a kept hash.  Templates shorter
   than that keep all of theirs.  The inverted index maps hashes to (template, place).
2. A text's hashes are looked up in the index.  Hits of a template on neighbouring diagonals form a seed.
3. Around a seed, template and text are aligned within a band of ``BAND`` words off the seed's diagonals: the longest common subsequence by
   dynamic programming over the band.  Matched words over template words is the coverage, the outermost matches give the span.  The words before and after an
   occurrence are aligned again, so notices that repeat closely are found one by one.

The templates are a constant of the module, or a parameter; their index is small and travels with the task.  Everything else is row-local.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from sentiloom.llm.common import grams, hash_words, map_batches, table
from sentiloom.llm.registry import llm_query

GRAM, WINDOW, BAND = 3, 4, 8
COVERAGE = 0.75

#: Fixed value: the disclaimer that ends the clauses below.
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Words that tell one license of a family from another; so do numbers.
DECIDING = {"sa", "nc", "nd", "lesser", "library", "affero", "cc0", "neither"}
SHORT = 20  # words of a template that is a single line

#: Public license lines and notices (name -> text).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License."),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software."),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_END),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        + _BSD_END),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."),
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."),
}

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def tokens(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes and code point spans of the words of a whole text."""
    found = [(m.group(), m.span()) for m in _WORD.finditer(text)]
    return hash_words([w.lower().encode() for w, _ in found]), [s for _, s in found]


def deciding(text: str) -> np.ndarray:
    """Which of the words of a text tell licenses of one family apart."""
    found = [w.lower() for w in _WORD.findall(text)]
    return np.fromiter((w in DECIDING or w.isdecimal() for w in found), bool, len(found))


def agrees(pairs: list[tuple[int, int]], needed: np.ndarray, given: np.ndarray) -> bool:
    """Whether the words that decide a license are matched: all of a line's, and of a longer notice those within the stretch it was found in.

    ``needed`` and ``given`` mark them in the template and in the text.  A line may hold none that the template lacks, also not as the next word.
    """
    (first, begin), (last, end) = pairs[0], pairs[-1]
    have = np.zeros(len(needed), dtype=bool)
    have[[i for i, _ in pairs]] = True
    line = len(needed) <= SHORT
    if (needed & ~have)[slice(None) if line else slice(first, last + 1)].any():
        return False
    foreign = given[begin : end + 1].copy()
    foreign[[j - begin for _, j in pairs]] = False
    return not (line and foreign.any())


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash (the rightmost of equals) of each ``window`` neighbours; of all if there are fewer."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """Inverted index of the templates' winnowed hashes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [tokens(templates[n])[0] for n in self.names]
        self.decides = [deciding(templates[n]) for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            if len(words):
                hashes = grams(words, GRAM)
                for i in winnow(hashes) if len(words) >= GRAM + WINDOW - 1 else range(len(hashes)):
                    self.places[int(hashes[i])].append((k, int(i)))
        self.known = np.array(sorted(self.places), np.uint64)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Longest common subsequence with text place - template place within [low, high]: the matched (template, text) places.

    One row per template word, one cell per diagonal of the band.
    """
    width, n = high - low + 1, len(text)
    best = np.zeros((len(template) + 1, width + 1), np.int32)  # the last column stays 0: beyond the band
    for i, word in enumerate(template):
        previous, row = best[i], best[i + 1]
        for d in range(width):
            j = i + low + d
            value = max(previous[d + 1] if d + 1 < width else 0, row[d - 1] if d else 0)
            if 0 <= j < n and text[j] == word:
                value = max(value, previous[d] + 1)
            row[d] = value
    pairs, i, d = [], len(template), int(best[-1, :width].argmax())
    while i > 0 and best[i, d] > 0:
        j = i - 1 + low + d
        if d and best[i, d - 1] == best[i, d]:
            d -= 1
        elif d + 1 < width and best[i - 1, d + 1] == best[i, d]:
            i, d = i - 1, d + 1
        elif 0 <= j < n and text[j] == template[i - 1] and best[i, d] == best[i - 1, d] + 1:
            pairs.append((i - 1, j))
            i -= 1
        else:
            i -= 1
    return pairs[::-1]


def occurrences(template: np.ndarray, words: np.ndarray, begin: int, end: int, low: int, high: int, least: float) -> list[list[tuple[int, int]]]:
    """Alignments of all occurrences within [begin, end) and the band, as (template place, text place); each leaves the words beside it to the others."""
    found, areas = [], [(begin, end)]
    while areas:
        a, b = areas.pop()
        if b - a < least * len(template):
            continue
        pairs = align(template, words[a:b], low - a, high - a)
        if not pairs or len(pairs) < least * len(template):
            continue
        # the end is the first one possible; seen from there, backwards, the start is the last one possible
        stop = a + pairs[-1][1] + 1
        size, n = len(template), stop - a
        # text place - template place is mirrored at (n - 1) - (size - 1)
        back = align(template[::-1], words[a:stop][::-1], n - size - (high - a), n - size - (low - a))
        pairs = [(size - 1 - i, stop - 1 - j) for i, j in back[::-1]]
        found.append(pairs)
        areas += [(a, pairs[0][1]), (pairs[-1][1] + 1, b)]
    return found


def scan(text: str, index: Index, least: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end, matched words, coverage) of each occurrence, by start; an occurrence inside another one is left out."""
    words, spans = tokens(text)
    if not len(words):
        return []
    hashes = grams(words, GRAM)
    # a text is as long as it is: its own winnowing would only thin the hits of templates shorter than a window
    hit = np.flatnonzero(np.isin(hashes, index.known))
    if not len(hit):
        return []
    given = deciding(text)
    seeds = sorted((k, int(j) - i) for j in hit for k, i in index.places[int(hashes[j])])
    found, at = [], 0
    while at < len(seeds):
        k, low = seeds[at]
        diagonals, at = [low], at + 1
        while at < len(seeds) and seeds[at][0] == k and seeds[at][1] - diagonals[-1] <= BAND and seeds[at][1] - low <= 4 * BAND:
            diagonals.append(seeds[at][1])
            at += 1
        template, high = index.words[k], diagonals[-1]
        begin, end = max(0, low - BAND), min(len(words), high + BAND + len(template))
        if len(template) <= SHORT and not np.isin(template[index.decides[k]], words[begin:end]).all():
            continue  # a line whose deciding words are not there
        aligned = []
        for d in sorted(set(diagonals)):  # a whole template needs no search; what lies between is aligned
            if d >= begin and np.array_equal(words[d : d + len(template)], template):
                aligned += occurrences(template, words, begin, d, low - BAND, high + BAND, least)
                aligned.append([(i, d + i) for i in range(len(template))])
                begin = d + len(template)
        aligned += occurrences(template, words, begin, end, low - BAND, high + BAND, least)
        for pairs in aligned:
            if agrees(pairs, index.decides[k], given):
                found.append((spans[pairs[0][1]][0], spans[pairs[-1][1]][1], index.names[k], len(pairs), len(pairs) / len(template)))
    return outermost(found)


def outermost(found: list[tuple]) -> list[tuple[str, int, int, int, float]]:
    """Occurrences that lie in no other one, by start; of equal spans that with most matched words, then the fullest, then by name.

    Two alignments of one template that share words are one occurrence.  Kept spans lie in no other, so sorted by start they are sorted by
    end too, and a look at the neighbours tells whether a span is inside one.
    """
    kept: list[tuple] = []
    by_name: dict[str, list[tuple]] = defaultdict(list)
    for f in sorted(set(found), key=lambda f: (f[0] - f[1], -f[3], -f[4], f[2], f[0])):  # longest first
        at = bisect.bisect_right(kept, f[0], key=lambda o: o[0])
        if at and kept[at - 1][1] >= f[1]:
            continue
        mine = by_name[f[2]]
        spot = bisect.bisect_right(mine, f[0], key=lambda o: o[0])
        if (spot and mine[spot - 1][1] > f[0]) or (spot < len(mine) and mine[spot][0] < f[1]):
            continue
        kept.insert(at, f)
        mine.insert(spot, f)
    return [(name, a, b, matched, coverage) for a, b, name, matched, coverage in kept]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row per occurrence: doc_id, license, start, end (code points, end exclusive), matched_words, coverage.

    Texts without an occurrence, null and empty texts give no rows; repeated rows give theirs each; a null doc_id is carried along.  Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        rows = [(doc_id.as_py(), *f) for doc_id, text in zip(*[batch.column(i) for i in range(2)]) for f in scan(text.as_py() or "", index, least)]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    kinds = {"doc_id": pa.int64(), "license": pa.string(), "start": pa.int64(), "end": pa.int64(), "matched_words": pa.int64(), "coverage": pa.float64()}
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each,
                       "doc_id long, license string, start long, end long, matched_words long, coverage double")


@llm_query("op4_licenses")
def op4_licenses(spark, folder):
    return license_scan(table(spark, folder, "documents"))
