"""License scans by patience alignment of texts with license templates.

Words are runs of letters and digits in lower case. Words that occur once in both the text and the
template anchor the alignment; the longest increasing subsequence of their positions is kept, and
the gaps between kept anchors are aligned in the same way. A gap without such a word is closed by
the words its two sides have in common at either end. Coverage is the share of the template's words
that were aligned; an alignment without an anchor counts for nothing. A template is laid on stretches around its rare words, and on stretches of twice the length again and
again up to the whole text, so text that is put into a license doesn't hide it; a notice of at most NOTICE words has to lie in one
sentence. The words that name a license, its kind and its version are no part of that
leeway: the alignment has to hold each marked phrase of a template as a whole, with nothing in between. A license within the
place of a longer one that is covered as well isn't told.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License texts and the notices by which works name their license, under SPDX names.
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = " Neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_MAY = ", and to permit persons to whom the Software is furnished to do so"
_MIT_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-text": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.',
    "MIT": _MIT,
    "MIT-text": _MIT + _MIT_MAY + _MIT_NOTICE + _MIT_AS_IS,
    "MIT-0-text": _MIT + _MIT_MAY + "." + _MIT_AS_IS,
    "ISC": _ISC + _ISC_NOTICE,
    "ISC-text": _ISC + _ISC_NOTICE + _ISC_AS_IS,
    "0BSD-text": _ISC + "." + _ISC_AS_IS,
    "BSD": _BSD,  # what the kinds of BSD licenses begin with
    "BSD-2-Clause": _BSD + _BINARY,
    "BSD-2-Clause-text": _BSD + _BINARY + _AS_IS,
    "BSD-3-Clause": _BSD + _BINARY + _ENDORSE,
    "BSD-3-Clause-text": _BSD + _BINARY + _ENDORSE + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
    "OFL-1.1": "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others.",
}
#: Phrases of a template that have to stand in the text word by word: what tells it from other templates and from prose.
MARKS = {
    "Apache-2.0": ["apache license", "2 0"],
    "MIT-text": ["this permission notice shall be included"],
    "ISC": ["this permission notice"],
    "ISC-text": ["this permission notice"],
    "BSD-2-Clause": ["in binary form must reproduce"],
    "BSD-2-Clause-text": ["in binary form must reproduce"],
    "BSD-3-Clause": ["in binary form must reproduce", "endorse or promote"],
    "BSD-3-Clause-text": ["in binary form must reproduce", "endorse or promote"],
    "MPL-2.0": ["mozilla public license", "2 0"],
    "EPL-2.0": ["eclipse public license 2 0"],
    "CC0-1.0": ["cc0 public domain dedication"],
}
# The family of GPL licenses: a word in the name, and versions.
for _name, _word, _versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[_id] = _GPL.format(_word, _v)
        TEMPLATES[f"{_id}-text"] = _GPL.format(_word, _v) + _GPL_REST.format(_word)
        MARKS[_id] = MARKS[f"{_id}-text"] = [f"gnu {_word.lower()}general public", f"version {_v} of"]
        TEMPLATES[f"{_id}-notice"] = f"under the GNU {_word}General Public License, version {_v}"
        MARKS[f"{_id}-notice"] = [f"gnu {_word.lower()}general public license", f"version {_v}"]
# Notices that name a license: the SPDX name and the phrase.
_NOTICES = {
    "Apache-2.0": "Apache License, Version 2.0", "Apache-1.1": "Apache License, Version 1.1", "MIT": "MIT License", "MIT-0": "MIT-0 License", "ISC": "ISC License", "BSD": "BSD License",
    "0BSD": "0BSD License", "Zlib": "zlib License", "BSL-1.0": "Boost Software License, Version 1.0", "MPL-2.0": "Mozilla Public License 2.0", "EPL-2.0": "Eclipse Public License 2.0",
    "PostgreSQL": "PostgreSQL License", "OFL-1.1": "SIL Open Font License, Version 1.1", "Artistic-2.0": "Artistic License 2.0", "EUPL-1.2": "European Union Public Licence, version 1.2",
}
for _id, _phrase in _NOTICES.items():
    TEMPLATES[f"{_id}-notice"] = f"under the {_phrase}"
    MARKS[f"{_id}-notice"] = [_phrase]
_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in _KINDS.items():
    for _v in ("3.0", "4.0"):
        # "CC-BY-4.0-notice" is the long form, "CC-BY-NC-4.0-notice" the short one.
        _long, _short = (f"CC-{_kind}-{_v}{x}" for x in (("-notice", "-short-notice") if _kind == "BY" else ("-long-notice", "-notice")))
        TEMPLATES[_long] = f"under a Creative Commons {_name} {_v} International License"
        MARKS[_long] = [f"creative commons {_name} {_v}"]
        TEMPLATES[_short] = f"under CC {_kind} {_v}"
        MARKS[_short] = [f"cc {_kind} {_v}"]
#: Least coverage of a template that counts as its license.
COVERAGE = 0.8
#: Words of text on which a template of n words is laid first: WINDOW x n to either side of each rare word of it.
WINDOW = 2
#: Words of the longest template that has to lie in one sentence.
NOTICE = 12
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[int]:
    """Where the sentences with words start, in words, and the number of all words; blank lines end a sentence too."""
    out = [0]
    for part in _BREAK.split(text.lower()):
        if n := sum(1 for _ in _WORD.finditer(part)):
            out.append(out[-1] + n)
    return out


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> tuple[list[tuple[int, int]], int]:
    """Pairs of positions (in text, in template), increasing in both, that hold equal words; and how many of them are anchors."""
    out: list[tuple[int, int]] = []
    anchored = 0
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        wanted = Counter(template[c:d])
        found = Counter(w for w in text[a:b] if w in wanted)
        place = {template[j]: j for j in range(c, d)}
        anchors = [(i, place[text[i]]) for i in range(a, b) if found[text[i]] == 1 and wanted[text[i]] == 1]
        if anchors:
            kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
            out += kept
            anchored += len(kept)
            for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
                todo.append((i + 1, k, j + 1, m))
            continue
        before = len(out)
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if len(out) > before:
            todo.append((a, b, c, d))  # without its ends the gap may have anchors
    return sorted(out), anchored


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The pairs of ``patience``."""
    return patience(text, template)[0]


class Scanner:
    """Finds the templates in a text.

    Templates of whose words a text doesn't hold enough, or not those of the marked phrases, are passed over, as are stretches; this
    loses nothing, as coverage is never above the bound of words in common. Whether and where a license stands is judged by the alignment alone.
    """

    def __init__(self, templates: dict[str, str], coverage: float, marks: dict[str, list[str]] = MARKS) -> None:
        self.coverage = coverage
        self.templates = [(name, words(t)) for name, t in templates.items()]
        # For each phrase of a template the places where it stands there.
        self.marks = []
        for name, t in self.templates:
            phrases = [words(p) for p in marks.get(name, ())]
            self.marks.append([[range(i, i + len(p)) for i in range(len(t)) if t[i : i + len(p)] == p] for p in phrases])
            if not all(self.marks[-1]):
                raise ValueError(f"a marked phrase isn't in template {name}")
        every = Counter(w for _, t in self.templates for w in set(t))
        common = {"the", "of", "and", "to", "in", "a", "is", "this", "with", "by", "at", "or", "you", "under", "not", "from", "for", "be", "are", "that", "on"}
        self.counts = [Counter(t) for _, t in self.templates]
        # Enough words of a template that at least one is in any text that covers it well enough.
        self.rare = []
        for _, t in self.templates:
            spare = len(t) - int(-(-coverage * len(t) // 1)) + 1
            order = sorted(range(len(t)), key=lambda i: (t[i] in common, every[t[i]], -len(t[i]), i))
            self.rare.append({t[i] for i in order[:spare]})
        self.by_word: dict[str, list[int]] = {}
        for k, rare in enumerate(self.rare):
            for w in rare:
                self.by_word.setdefault(w, []).append(k)
        self.named = [{x for p in marks.get(name, ()) for x in words(p)} for name, _ in self.templates]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, last word + 1, anchors) of each template's best place that covers enough."""
        w = words(text)
        every = set(w)
        wanted = sorted({k for x in self.by_word.keys() & every for k in self.by_word[x]})
        if not wanted:
            return []
        count, cuts, out = Counter(w), None, []
        for k in wanted:
            name, t = self.templates[k]
            if sum(min(n, count[x]) for x, n in self.counts[k].items()) < self.coverage * len(t) or not self.named[k] <= every:
                continue
            if len(t) <= NOTICE:
                cuts = cuts or sentences(text)
            if best := self._best(w, t, k, cuts if len(t) <= NOTICE else [0, len(w)]):
                out.append((name, *best))
        # Of places within one another the longer template's counts, if it is covered as well.
        sizes = {name: len(t) for name, t in self.templates}
        inside = lambda x, y: y[2] <= x[2] and x[3] <= y[3] and sizes[x[0]] < sizes[y[0]] and x[1] <= y[1]
        return [x for x in out if not any(inside(x, y) for y in out)]

    def _best(self, w: list[str], t: list[str], k: int, cuts: list[int]) -> tuple[float, int, int, int] | None:
        """Coverage, first word, last word + 1 and anchors of the template's best place, over stretches between cuts of doubling length up to the longest."""
        at = [i for i, x in enumerate(w) if x in self.rare[k]]
        longest = max(z - a for a, z in zip(cuts, cuts[1:]))
        reach, best, near = WINDOW * len(t), None, True
        while True:
            seen = -1
            for i in at:
                if i < seen:
                    continue
                cut = bisect_right(cuts, i)
                a, b = max(cuts[cut - 1], i - reach), min(cuts[cut], i + 2 * reach)
                seen = min(cuts[cut], i + reach)
                part = w[a:b]
                found = Counter(x for x in part if x in self.counts[k])
                if sum((found & self.counts[k]).values()) < self.coverage * len(t) or not self.named[k] <= found.keys():
                    continue
                pairs, anchors = self._place(part, t, self.marks[k], near)
                share = len(pairs) / len(t)
                if share >= self.coverage and (best is None or share > best[0]):
                    best = (share, a + pairs[0][0], a + pairs[-1][0] + 1, anchors)
            if reach >= longest or best and best[0] == 1:
                return best
            reach, near = 2 * reach, False

    def _place(self, part: list[str], t: list[str], marks: list[list[range]], near: bool = True) -> tuple[list[tuple[int, int]], int]:
        """The best alignment of the template with the stretch, or in near ones with the windows of its length within it, that holds the marks; and its anchors."""

        def sound(pairs: list[tuple[int, int]], anchors: int) -> bool:
            at = {q: p for p, q in pairs}
            return anchors > 0 and all(any(all(at.get(q, -1) == at.get(m[0], -2) + q - m[0] for q in m) for m in spots) for spots in marks)

        whole = patience(part, t)
        best = whole if sound(*whole) else ([], 0)
        if near and len(best[0]) < len(t):
            first = Counter(t)
            starts = [i for i, x in enumerate(part) if x in first]
            for i in starts:
                # From each place of the word in the template.
                for j in [j for j, x in enumerate(t) if x == part[i]] if marks else [t.index(part[i])]:
                    at = max(0, i - j)
                    pairs, anchors = patience(part[at : at + len(t) + 2], t)
                    if len(pairs) > len(best[0]) and sound(pairs, anchors):
                        best = [(at + p, q) for p, q in pairs], anchors
                if len(best[0]) == len(t):
                    break
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, marks: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, license, coverage, n_found, found.

    ``found`` lists (license, coverage, start, end, anchors) of every template that is covered well enough, in word
    positions, with the number of words that anchor its alignment; license and coverage are the best one's (null and 0.0 where none is), of equals the
    longer template's, then the first in the alphabet. ``marks`` are the phrases of each template that have
    to be aligned whole (MARKS for our own templates). A null or empty text has none. Repeated rows are judged alike.
    """
    marks = marks if marks is not None else MARKS if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    lengths = {k: len(words(t)) for k, t in templates.items()}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("anchors", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, marks)
        for batch in batches:
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            best = [min(f, key=lambda x: (-x[1], -lengths[x[0]], x[0]), default=(None, 0.0)) for f in found]
            rows = [[{"license": n, "coverage": c, "start": a, "end": b, "anchors": m} for n, c, a, b, m in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array(rows, kind)],
                ["doc_id", "license", "coverage", "n_found", "found"],
            )

    schema = "doc_id long, license string, coverage double, n_found int, found array<struct<license:string,coverage:double,start:long,end:long,anchors:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
