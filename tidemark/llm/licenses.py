"""License scans: winnowed fingerprints find candidates, banded alignment confirms them.

Each template's runs of GRAM words are hashed and winnowed: of every WINNOW
neighbouring hashes the least stays. The kept ones form an inverted index from
hash to template and place, a few kilobytes that travel with the tasks. Every
run of GRAM words of a text is looked up in it, so a shared passage of
GRAM + WINNOW - 1 words always meets the index. Changed words can break all such
runs, so a template has anchors too: so many of its rarer words that no match of
MIN_COVERAGE can do without them. Each hit names a diagonal, and a banded
alignment of the words there with the template's reports how much of the
template is matched, in order, and where. What lies between the regions found is
aligned again, so that copies side by side are reported apart. Short templates,
under GRAM + WINNOW - 1 words, keep all their hashes, and those under GRAM words
have none and are found by their anchors. The built-in templates are notices,
headers and the texts of short licenses; the long ones (GPL, Apache and MPL whole)
are not among them and can be given as `templates`.

Edge cases: no templates, or templates without words, find nothing; a null or wordless text gives no row; a text may hold several
licenses or copies, each a row; rows with equal ids are scanned apart; an empty
table gives an empty one; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, window_hashes, word_hashes, word_spans

GRAM, WINNOW, BAND = 4, 4, 12
MIN_COVERAGE = 0.6
#: Words of ordinary prose, the last choice for anchors.
COMMON = frozenset("a an and any as at be by copy distributed do file following for free from hereby in is it its license licensed may more new not of on or part program released software source that the then this to under use version with without work you".split())

#: Fixed texts: notices of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Fixed texts: well-known licenses that are short enough to be given whole, and headers of others.
FULL_TEXTS = {
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}


def _words(text: str) -> np.ndarray:
    buf, starts, ends, _ = word_spans([text], lower=True)
    return word_hashes(buf, starts, ends)


class Index:
    """The inverted index of winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [_words(t) for t in templates.values()]
        hashes, where = [], []
        for k, words in enumerate(self.words):
            runs = window_hashes(words, GRAM)
            if len(runs) <= WINNOW:
                picked = range(len(runs))
            else:
                picked = sorted({i + int(runs[i : i + WINNOW].argmin()) for i in range(len(runs) - WINNOW + 1)})
            for i in picked:
                hashes.append(runs[i])
                where.append((k, i))
        self.need = [max(1, int(np.ceil(MIN_COVERAGE * len(words) - 1e-9))) for words in self.words]
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (words, text) in enumerate(zip(self.words, templates.values())):
            names = [w.strip(",.;:()\"").lower() for w in text.split()]
            names += [""] * (len(words) - len(names))
            rare = sorted(range(len(words)), key=lambda i: (names[i] in COMMON, -len(names[i]) if len(names) > GRAM + WINNOW else 0, i))
            for i in rare[: len(words) - self.need[k] + 1]:
                self.anchors[int(words[i])].append((k, i))
        self.anchor_words = np.array(sorted(self.anchors), np.uint64)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.where = [where[i] for i in order]

    def hits(self, runs: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the runs) for every run that the index has."""
        left = np.searchsorted(self.hashes, runs, "left")
        found = np.flatnonzero((left < len(self.hashes)) & (self.hashes[np.minimum(left, len(self.hashes) - 1)] == runs)) if len(self.hashes) else []
        out = []
        for p in found:
            j = left[p]
            while j < len(self.hashes) and self.hashes[j] == runs[p]:
                out.append((*self.where[j], int(p)))
                j += 1
        return out


def align(template: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The longest common subsequence within BAND of the diagonal text = template + shift: its length, and the first and last matched place in the text (-1 without any)."""
    n = len(template)
    before: dict[int, tuple[int, int, int]] = {}
    best = (0, -1, -1)
    for i in range(n):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, -1, -1)
        for j in range(max(0, i + shift - BAND), min(len(text), i + shift + BAND + 1)):
            up, corner = before.get(j, (0, -1, -1)), before.get(j - 1, (0, -1, -1))
            cell = max(left, up, key=lambda c: (c[0], c[1]))
            if template[i] == text[j]:
                met = (corner[0] + 1, corner[1] if corner[0] else j, j)
                cell = max(cell, met, key=lambda c: (c[0], c[1]))
            row[j] = left = cell
            if cell[0] > best[0]:
                best = cell
        before = row
    return best


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def regions(template: np.ndarray, words: np.ndarray, votes: Counter[int], need: int) -> list[tuple[int, int, int]]:
    """(first word, last word, matched words) of parts that do not overlap, the fullest first, and again in what they leave."""
    n, inside = len(template), np.concatenate([[0], np.cumsum(among(words, np.unique(template)))])
    shifts = sorted(votes)
    out, gaps = [], [(0, len(words))]
    while gaps:
        lo, hi = gaps.pop()
        found = []
        near = shifts[bisect_left(shifts, lo - n - BAND) : bisect_right(shifts, hi + BAND)]
        for shift in sorted(near, key=lambda x: (-votes[x], x)):
            a, b = max(lo, shift - BAND), min(hi, shift + n + BAND)
            if b - a < need or inside[b] - inside[a] < need:
                continue
            if any(x[2] == n and x[0] < b and a <= x[1] for x in found):
                continue  # beside a full one: left to the next turn
            matched, first, last = align(template, words[a:b], shift - a)
            if matched >= need:
                found.append((a + first, a + last, matched))
        chosen: list[tuple[int, int, int]] = []
        for x in sorted(set(found), key=lambda x: (-x[2], x[0])):
            if not any(x[0] <= y[1] and y[0] <= x[1] for y in chosen):
                chosen.append(x)
        if chosen:
            edges = [lo, *(e for x in sorted(chosen) for e in (x[0], x[1] + 1)), hi]
            gaps += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= need]
        out += chosen
    return out


def scan_text(index: Index, words: np.ndarray) -> list[tuple[str, int, int, int, float]]:
    """(template, first word, last word, matched words, coverage) of each region that covers MIN_COVERAGE."""
    votes: dict[int, Counter[int]] = defaultdict(Counter)
    for k, i, p in index.hits(window_hashes(words, GRAM)):
        votes[k][p - i] += GRAM
    for p in np.flatnonzero(among(words, index.anchor_words)):
        for k, i in index.anchors[int(words[p])]:
            votes[k][int(p) - i] += 1
    out = []
    for k, shifts in votes.items():
        n = len(index.words[k])
        out += [(index.names[k], first, last, matched, matched / n) for first, last, matched in regions(index.words[k], words, shifts, index.need[k])]
    # words inside a fuller region of another template speak for that one: the GPL's line holds five of the Apache line's seven words
    lesser = {x for x in out if x[4] < 1 and any(x[4] < y[4] and x[3] < y[3] and y[1] <= x[1] and x[2] <= y[2] for y in out)}
    return sorted((x for x in out if x not in lesser), key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per license found: doc_id, license, first_word, last_word (0-based), start_byte, end_byte (in UTF-8), matched_words, coverage."""
    index = Index(TEMPLATES | FULL_TEXTS if templates is None else templates)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id").schema
    for name, kind in (("license", "string"), ("first_word", "long"), ("last_word", "long"), ("start_byte", "long"), ("end_byte", "long"), ("matched_words", "long"), ("coverage", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, rows = batch.column("text").to_pylist(), [], []
            for a, b in chunks(texts):
                buf, starts, ends, first = word_spans(texts[a:b], lower=True)
                words = word_hashes(buf, starts, ends)
                text_bytes = np.cumsum([1] + [len(t.encode("utf-8", "replace")) + 1 if t else 1 for t in texts[a:b]])
                runs = window_hashes(words, GRAM)
                at_words = np.concatenate([np.flatnonzero(among(runs, index.hashes)), np.flatnonzero(among(words, index.anchor_words))])
                hot = np.unique(np.searchsorted(first, at_words, "right") - 1)
                for i in hot:  # texts with a fingerprint or an anchor; runs across two texts find nothing there
                    own = words[first[i] : first[i + 1]]
                    for name, s, e, matched, coverage in scan_text(index, own):
                        at.append(a + i)
                        zero = text_bytes[i]
                        rows.append((name, s, e, int(starts[first[i] + s] - zero), int(ends[first[i] + e] - zero), matched, coverage))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    return source.mapInArrow(run, schema)


def brute_force(templates: dict[str, str], text: str) -> set[str]:
    """Templates whose words stand in the text in one piece, A-Z lowered, for checks."""
    low = " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).lower()
    return {name for name, t in templates.items() if " ".join(t.split()).lower() in low}
