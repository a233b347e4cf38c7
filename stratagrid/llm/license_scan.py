"""License scans by patience alignment.

A template's coverage in a text is the share of its words that an alignment matches. The alignment anchors on words
that occur once in both, takes the longest ascending run of anchors, and goes on inside the gaps between them, where
further words are unique; equal words at a gap's ends are matched first.

Texts are scanned from left to right for each template. A find begins at the first word of the template's vocabulary whose
window, of half as many words again as the template, covers enough of it; the window is then moved to the first word that
matched, as long as that covers more. The scan goes on behind the last word that matched, so notices back to back are
finds of their own, and where a notice stands does not matter. A window that fails with some matched words is followed by
the first one that could have enough, as each word of the way brings one at most. Windows are aligned only where they hold
enough of the template's words, each counted as often as the template has it, which no alignment can exceed; that count is
kept from word to word, and texts with too few such words in all are left at once. Whole texts are scanned.

A find inside another with more matched words, of another template, is part of that one.
"""

from __future__ import annotations

import pathlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text as tx
from .toxicity import MARKS

# Public license texts and notices, word for word.
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""
#: By name: whole short licenses, the notices that longer ones ask for, and one-line statements.
NOTICES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT (permission)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT (statement)": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_TWO + " " + _BSD_DISCLAIMER,
    "BSD-2-Clause (conditions)": _BSD_TWO,
    "BSD-3-Clause": _BSD_TWO
    + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. """
    + _BSD_DISCLAIMER,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0 (notice)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-or-later (notice)": """This program is free software; you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "GPL-3.0-or-later (notice)": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "AGPL-3.0-or-later (notice)": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details.""",
    "MPL-2.0 (notice)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (statement)": "Licensed under CC BY 4.0.",
}
FOUND = "license: string, coverage: double, matched: bigint, start_word: bigint, end_word: bigint"


def templates() -> dict[str, str]:
    """NOTICES, and the whole longer licenses that lie beside this module as text files, by name."""
    folder = pathlib.Path(__file__).resolve().parent / "licenses"
    return NOTICES | {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))}


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j), both ascending, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if cb[x] == 1 and ca.get(x) == 1}
        pairs = [(k, place[x]) for k, x in enumerate(a[i:m], i) if x in place]
        # longest ascending run of the anchors' places in b: patience sorting
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, y) in enumerate(pairs):
            pile = bisect_left(tops, y)
            tops[pile : pile + 1] = [y]
            ends[pile : pile + 1] = [k]
            before.append(ends[pile - 1] if pile else -1)
        run, k = [], ends[-1] if ends else -1
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        if not run:
            continue
        out += run
        edges = [(i - 1, j - 1), *reversed(run), (m, n)]
        work += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def finds(words: list, text: list, least: float, places: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(matched words, first word, end word) of a template's finds in a text, from left to right.

    places: where the text has words of the template, ascending; any word if None."""
    enough, width = -(-round(least * len(words) * 1e6) // 10**6), len(words) + -(-len(words) // 2)
    need = Counter(words)
    places = [i for i, x in enumerate(text) if x in need] if places is None else places
    out: list[tuple[int, int, int]] = []
    have: Counter = Counter()
    bound, left, right, begin = 0, 0, 0, 0
    while left < len(places):
        start = places[left]
        while right < len(places) and places[right] < start + width:
            x = text[places[right]]
            have[x] += 1
            bound += have[x] <= need[x]
            right += 1
        if start >= begin and bound >= enough:
            pairs = matches(words, text[start : start + width])
            if len(pairs) >= enough:
                while (first := start + pairs[0][1]) != start:
                    better = matches(words, text[first : first + width])
                    if len(better) <= len(pairs):
                        break
                    start, pairs = first, better
                out.append((len(pairs), start + pairs[0][1], start + pairs[-1][1] + 1))
                begin = out[-1][2]
            else:
                begin = start + max(1, enough - len(pairs))
        x = text[places[left]]
        bound -= have[x] <= need[x]
        have[x] -= 1
        left += 1
    return out


class Scanner:
    def __init__(self, bodies: dict[str, str], least: float):
        self.least, self.names, self.bodies = least, [], []
        for name, body in bodies.items():
            h = _hashes(*tx.buffers(pa.array([body])))[0]
            if len(h):
                self.names.append(name)
                self.bodies.append(h)
        self.vocabulary = np.unique(np.concatenate(self.bodies)) if self.bodies else np.zeros(0, tx.U64)
        self.member = np.array([np.isin(self.vocabulary, h) for h in self.bodies])
        self.least_words = np.array([least * len(h) for h in self.bodies])

    def scan(self, texts: list[np.ndarray]) -> list[list[tuple[str, float, int, int, int]]]:
        """For each text (template, coverage, matched words, first word, end word) of its finds, in order of place."""
        out: list[list] = [[] for _ in texts]
        if not len(self.vocabulary) or not texts:
            return out
        h, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        first = np.cumsum([0, *(len(x) for x in texts)])
        where = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[where] == h)
        where, row = where[at], row[at]
        for t, words in enumerate(self.bodies):
            mine = self.member[t][where]
            likely = np.flatnonzero(np.bincount(row[mine], minlength=len(texts)) >= self.least_words[t])
            if not len(likely):
                continue
            spots, owner = at[mine], row[mine]
            edges = np.searchsorted(owner, [likely, likely + 1])
            for i, a, b in zip(likely.tolist(), *edges.tolist(), strict=True):
                for n, s, e in finds(words.tolist(), texts[i].tolist(), self.least, (spots[a:b] - first[i]).tolist()):
                    out[i].append((self.names[t], n / len(words), n, s, e))
        return [self.whole(x) for x in out]

    @staticmethod
    def whole(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        """Without the finds that lie inside one with more matched words."""
        kept: list = []
        for f in sorted(found, key=lambda f: (-f[2], f[4] - f[3], f[3], f[0])):
            if not any(k[3] <= f[3] and f[4] <= k[4] and k[2] > f[2] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[3], f[4], f[0]))


def _hashes(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    low = tx.lower_ascii(buf)
    low = np.where(MARKS[low], np.uint8(32), low)
    starts, ends, ptr = tx.words(low, off)
    h = tx.word_hashes(low, starts, ends)
    return [h[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def _scan(bodies: dict[str, str], least: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(bodies, least)
        for b in batches:
            rows: list[list[dict]] = []
            for _, _, buf, off in tx.slices(b.column("text")):
                for found in scanner.scan(_hashes(buf, off)):
                    rows.append([dict(zip(("license", "coverage", "matched", "start_word", "end_word"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([b.column("carry"), pa.array(rows, kind)], ["carry", "found"])

    return tx.trimmed(run)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, bodies: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """The columns in carry (default doc_id), found (array of license, coverage, matched, start_word, end_word, in order of
    place) and license, coverage of the best of them: the most words matched, then the coverage, then the name. A row for
    each of docs.

    bodies: templates by name, templates() if None. Words are runs of bytes other than white space and ASCII punctuation,
    A-Z lower-cased. Null and empty texts, texts without a notice, and all texts if there are no templates, have an empty
    array and nulls. Repeated rows are scanned as often as they come. Finds of one template do not overlap; those of
    different templates can, but for one that lies inside another with more matched words, which is not listed.
    """
    shared.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(carry or ["doc_id"])).alias("carry"), F.col(text).alias("text"))
    kind = rows.schema["carry"].dataType.simpleString()
    out = rows.mapInArrow(_scan(templates() if bodies is None else bodies, least), f"carry {kind}, found array<struct<{FOUND}>>")
    best = F.expr("array_max(transform(found, f -> struct(f.matched AS matched, f.coverage AS coverage, f.license AS license)))")
    return out.withColumn("best", best).select("carry.*", "found", F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"))
