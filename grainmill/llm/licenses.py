"""License scans (op 5) by patience alignment of texts with license templates.

Texts and templates are words (lower case, runs of letters and digits). Where a text holds enough of a template's words close
together, that region is aligned with the template: words that occur once in both are anchors, the longest increasing run of them
stays, and the gaps between them are aligned in the same way; equal words next to an anchor are taken along. Coverage is the share
of the template's words that are aligned, in the best run without a break of more than ``MAX_GAP`` words of text, or a quarter of the template's length if that is
more: a name or a line that is put into a license doesn't break it.

Regions: a window of ``SLACK * n + MAX_GAP`` words from a word of the template on is aligned if it holds as many distinct words of
the template, and as many pairs of words that follow each other in the template, as the coverage takes at least. So no alignment within such a window is missed, and texts
without one (nearly all) cost no Python step. Where a window matches, the search goes on behind the match: a text can hold a license more than once.

Defined cases: null, empty or short texts give no rows; the same region may match more than one template (a notice within a whole
license, or two licenses that share their wording), each is a row; of two equally long runs the earlier counts; a match begins with an aligned word; repeated rows are reported each; further columns are ignored; doc_id has to be an integer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import text as tx
from grainmill.session import attach

COVERAGE = 0.85
MAX_GAP = 6
SLACK = 1.25
#: ASCII lower case, byte by byte, so that offsets stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-text": _BSD + '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ' + _BSD_END,
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of "
        "the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
}

SCHEMA = "doc_id long, license string, start int, end int, coverage double"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second increases, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
        back[k] = piles[p - 1] if p else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of equal elements, increasing in both, by patience alignment with recursion into the gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        at = {w: y for y, w in enumerate(b[j:n], j) if cb[w] == 1}
        anchors = _rising([(x, at[w]) for x, w in enumerate(a[i:m], i) if ca[w] == 1 and w in at])
        if not anchors:
            continue
        out += anchors
        for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)]):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def best_run(pairs: list[tuple[int, int]], max_gap: int = MAX_GAP) -> list[tuple[int, int]]:
    """The longest run of pairs without a step of more than ``max_gap`` + 1 in the first index; the earliest of equals."""
    best, start = (0, 0), 0
    for k in range(len(pairs)):
        if k and pairs[k][0] - pairs[k - 1][0] > max_gap + 1:
            start = k
        if k + 1 - start > best[1] - best[0]:
            best = start, k + 1
    return pairs[best[0] : best[1]]


class Template:
    def __init__(self, name: str, text: str) -> None:
        raw, off = tx.utf8(pc.utf8_lower(pa.array([text])))
        s, e, _ = tx.spans(raw, off, tx.ALNUM)
        self.name, self.words = name, tx.span_hashes(raw, s, e).tolist()
        self.vocab = np.unique(np.array(self.words, np.uint64))
        self.pairs = np.unique(_pairs(np.array(self.words, np.uint64)))
        n = len(self.words)
        self.gap = max(MAX_GAP, n // 4)
        self.reach = int(SLACK * n) + MAX_GAP


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each word and the next."""
    with np.errstate(over="ignore"):
        return tx.mix64(h[:-1]) + h[1:]


def _match(h: np.ndarray, x: int, t: Template, coverage: float) -> tuple[int, float] | None:
    """End and coverage of the match that begins with word ``x``."""
    n = len(t.words)
    best: list[tuple[int, int]] = []
    for size in (t.reach, n):
        run = best_run(align(h[x : x + size].tolist(), t.words), t.gap)
        best = run if len(run) > len(best) else best
    if best and best[0][0] == 0 and len(best) >= coverage * n - 1e-9:
        return x + best[-1][0] + 1, len(best) / n
    return None


def scan_words(h: np.ndarray, t: Template, coverage: float = COVERAGE) -> list[tuple[int, int, float]]:
    """(first word, end, coverage) of each place in a text (word hashes) that covers enough of the template."""
    n = len(t.words)
    # (1 - coverage) of the words may be missing, at worst all the occurrences of as many distinct ones
    need = max(1, len(t.vocab) - int(n * (1 - coverage) + 1e-9))
    kind = tx.lookup(h, t.vocab)
    at = np.flatnonzero(kind >= 0)
    if len(at) < need:
        return []
    # k aligned words have k - 1 steps; each that doesn't go to the next word of both passes over one of the rest of the window or of the template
    k = int(np.ceil(coverage * n - 1e-9))
    follow = max(0, (k - 1) - (t.reach - k) - (n - k))
    steps = np.zeros(len(h) + 1, np.int64)
    np.cumsum(tx.lookup(_pairs(h), t.pairs) >= 0, out=steps[1 : len(h)])
    steps[len(h) :] = steps[len(h) - 1]
    good = steps[np.minimum(at + t.reach - 1, len(h) - 1)] - steps[at] >= follow
    if not good.any():
        return []
    kind = kind[at].tolist()
    upto = np.searchsorted(at, at + t.reach)
    out, seen, hi, begin = [], Counter(), 0, 0
    for k, x in enumerate(at.tolist()):
        while hi < upto[k]:
            seen[kind[hi]] += 1
            hi += 1
        if x >= begin and len(seen) >= need and good[k] and (found := _match(h, x, t, coverage)):
            out.append((x, *found))
            begin = found[0]
        seen[kind[k]] -= 1
        if not seen[kind[k]]:
            del seen[kind[k]]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, start, end`` (characters) and ``coverage`` for each place that covers enough of a template. No shuffle."""
    attach(docs.sparkSession)
    known = TEMPLATES if templates is None else templates
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
    names = ["doc_id", "license", "start", "end", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ts = [t for t in (Template(k, v) for k, v in known.items()) if t.words]
        vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.vocab for t in ts)]))
        holds = [np.isin(vocab, t.vocab) for t in ts]
        for b in batches:
            raw, off = tx.utf8(b.column(1))
            rows = []
            for x, y in tx.slices(off):
                part, o = raw[off[x] : off[y]], off[x : y + 1] - off[x]
                s, e, first = tx.spans(LOWER[part], o, tx.ALNUM)
                h = tx.span_hashes(LOWER[part], s, e) if len(s) else np.zeros(0, np.uint64)
                chars = None
                # which words of any template each document has
                which = tx.lookup(h, vocab)
                hit = np.flatnonzero(which >= 0)
                pairs = np.unique((np.searchsorted(first, hit, "right") - 1) * len(vocab) + which[hit]) if len(hit) else np.zeros(0, np.int64)
                doc, word = np.divmod(pairs, max(1, len(vocab)))
                for t, has in zip(ts, holds, strict=True):
                    # documents with enough different words of the template at all
                    n = np.bincount(doc[has[word]], minlength=y - x)
                    least = max(1, len(t.vocab) - int(len(t.words) * (1 - coverage) + 1e-9))
                    for d in np.flatnonzero(n >= least):
                        for lo, hi, c in scan_words(h[first[d] : first[d + 1]], t, coverage):
                            chars = tx.char_positions(part) if chars is None else chars
                            i, j = s[first[d] + lo], e[first[d] + hi - 1]
                            rows.append((b.column(0)[x + d].as_py(), t.name, int(chars[i] - chars[o[d]]), int(chars[j] - chars[o[d]]), c))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return slim.mapInArrow(run, SCHEMA)
