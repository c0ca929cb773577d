"""Licence scans by patience alignment.

A template is found in a text by anchoring on words that are unique in both, taking the longest increasing
subsequence of the anchors, and aligning the gaps between them in the same way; gaps without unique words are aligned
exactly, whatever their size, by a bit-parallel longest common subsequence. Coverage is the share of the template's words
that are aligned.

A text is scanned whole, from left to right, for each template. From a place on, windows of three template lengths at
steps of one are taken, so aligned words that stand within two lengths of each other lie in one window. In a window the
earliest end and then the latest start are sought between which a common subsequence reaches the least coverage; the
words around, as many as the template may still lack, join them for the patience alignment. The scan goes on behind the last
aligned word, so copies in a row are found one by one. Windows (and texts) with too few of the template's rarer words
for the least coverage are passed over, which loses nothing, as each aligned word must occur. Of overlapping finds of
several templates that with more aligned words stays.

Null and empty texts have no finds, nor do templates without words. Ties between templates go to the earlier find, then
to the name. Each row is scanned on its own, so repeated rows, hot sources and other columns need no care; the work follows
a text's length. An empty table gives an empty result. Spans are code points of the original text, end exclusive."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

LEAST_COVERAGE = 0.8
#: Template lengths that a window holds, and steps between windows.
WINDOW, STEP = 3, 1
_WORD = re.compile(r"[A-Za-z0-9]+")
_WORD_BYTES = re.compile(rb"[a-z0-9]+")
#: Words that don't count as rare when windows are passed over.
COMMON = frozenset("a all an and any are as at be by for from in is it no not of on or that the this to under with you".split())
# Notices and statements of public licences, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Reserved": "All rights reserved",
}


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        counts = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: k for k, w in enumerate(b[j:j_end], j) if counts[1][w] == 1 and counts[0].get(w) == 1}
        anchors = _increasing([(k, where[w]) for k, w in enumerate(a[i:i_end], i) if w in where])
        if anchors:
            out.extend(anchors)
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            todo.extend((p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:]))
        else:
            out.extend((i + x, j + y) for x, y in _longest_common(a[i:i_end], b[j:j_end]))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that also increases in the second places, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[k], piles[k] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _bits(words: list[str]) -> dict[str, int]:
    """For each word the places where it stands, as bits."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of one longest common subsequence. Row j holds, as zero bits, where the common length of a's beginnings
    with b's first j words grows; a row takes len(a) bits."""
    full, where = (1 << len(a)) - 1, _bits(a)
    rows = [full]
    for w in b:
        v = rows[-1]
        u = v & where.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    common = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    out, i, j = [], len(a), len(b)
    k = common(i, j)
    while k:
        if common(i, j - 1) == k:
            j -= 1
        elif common(i - 1, j) == k:
            i -= 1
        else:
            i, j, k = i - 1, j - 1, k - 1
            out.append((i, j))
    return out[::-1]


def _first_end(words: list[str], where: dict[str, int], size: int, need: int) -> int | None:
    """How many of the words it takes, at least, until a common subsequence with a template has `need` words."""
    full = v = (1 << size) - 1
    for k, w in enumerate(words, 1):
        u = v & where.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            if size - v.bit_count() >= need:
                return k
    return None


class Scanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        words = {n: [m.group().lower() for m in _WORD.finditer(t)] for n, t in templates.items()}
        self.words = {n: w for n, w in words.items() if w}
        self.rare = {n: frozenset(w) - COMMON for n, w in self.words.items()}
        #: Aligned words that a find has at least.
        self.enough = {n: max(1, math.ceil(least * len(w) - 1e-9)) for n, w in self.words.items()}
        # of these, common words can't be more than the template has
        self.need = {n: max(1, self.enough[n] - sum(x in COMMON for x in w)) for n, w in self.words.items()}
        self.where = {n: (_bits(w), _bits(w[::-1])) for n, w in self.words.items()}
        # each set of words must meet every text with a find
        self.any = frozenset().union(*self.rare.values())

    def scan(self, text: str, raw: bytes) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of the finds, by start."""
        lower = _WORD_BYTES.findall(raw.lower())
        present = self.any.intersection(x.decode() for x in set(lower))
        names = [n for n in self.words if len(self.rare[n] & present) >= self._distinct(n)]
        if not names:
            return []
        places = list(_WORD.finditer(text))
        words = [m.group().lower() for m in places]
        finds = [(k, n, i, j) for n in names for k, i, j in self.finds_of(n, words)]
        finds.sort(key=lambda x: (-x[0], x[2], x[1]))
        begins: list[int] = []
        taken: list[tuple[int, str, int, int]] = []
        for x in finds:
            at = bisect_left(begins, x[2])
            if (at == 0 or taken[at - 1][3] <= x[2]) and (at == len(taken) or x[3] <= taken[at][2]):
                begins.insert(at, x[2])
                taken.insert(at, x)
        return [(n, places[i].start(), places[j - 1].end(), k / len(self.words[n])) for k, n, i, j in taken]

    def finds_of(self, name: str, words: list[str]) -> list[tuple[int, int, int]]:
        """(aligned words, start, end) of one template's finds, which don't overlap, in the order of the words."""
        template, rare, enough = self.words[name], self.rare[name], self.enough[name]
        size, (ahead, back) = len(template), self.where[name]
        before = [0]
        for w in words:
            before.append(before[-1] + (w in rare))
        out, at, begin = [], 0, 0  # windows from `at` on; nothing before `begin` may be taken again
        while at < len(words):
            stop = min(len(words), at + WINDOW * size)
            end = _first_end(words[at:stop], ahead, size, enough) if before[stop] - before[at] >= self.need[name] else None
            if end is None:
                if stop == len(words):
                    break
                at += STEP * size
                continue
            end += at
            start = end - _first_end(words[at:end][::-1], back, size, enough)
            spare = size - enough + size // 4
            low, high = max(begin, start - spare), min(len(words), end + spare)
            pairs = patience(words[low:high], template)
            if len(pairs) < enough:
                low, pairs = start, _longest_common(words[start:end], template)
            # loose ends: the tightest stretch with as many common words
            k = len(pairs)
            tail = low + _first_end(words[low : low + pairs[-1][0] + 1], ahead, size, k)
            head = tail - _first_end(words[low:tail][::-1], back, size, k)
            out.append((k, head, tail))
            at = begin = tail
        return out

    def _distinct(self, name: str) -> int:
        """Distinct rare words at least: the aligned rare words can repeat at most as in the template."""
        need, out = self.need[name], 0
        for n in sorted(Counter(w for w in self.words[name] if w in self.rare[name]).values(), reverse=True):
            if need <= 0:
                break
            need, out = need - n, out + 1
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license (of the find with most aligned words, else null), coverage, n_finds and finds (array of
    template, start, end, coverage) of every row."""
    find = pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_finds", pa.int64()), ("finds", pa.list_(find))])
    own = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(own, least_coverage)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = scanner.scan(text, text.encode()) if text else []
                best = max(found, key=lambda x: (x[3] * len(scanner.words[x[0]]), -x[1]), default=(None, 0, 0, None))
                rows.append((best[0], best[3], len(found), [dict(zip(("template", "start", "end", "coverage"), x, strict=True)) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], schema[i + 1].type) for i in range(4))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, license string, coverage double, n_finds long, finds array<struct<template:string,start:long,end:long,coverage:double>>")
