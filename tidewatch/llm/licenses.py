"""License scan (op5): winnowed fingerprints pick candidates, banded alignment confirms them.

Every template is a list of words; its GRAM-word hashes are winnowed (the least of each
window of WINNOW) into an inverted index fingerprint -> (template, place).  All word
grams of a whole text are looked up, so a template whose fingerprint occurs is found
wherever it stands.  Hits on one diagonal band become a candidate, and an alignment
within BAND words of that diagonal gives the words of the template that are matched in
order, and where.  A candidate counts with at least MIN_COVERAGE of the template's words, with
each of its `must` phrases in the matched span word for word (a version number, a clause, a
variant), and with none of its `never` words.  Of candidates that overlap by more than half of
the shorter one, the one with more matched words is reported, so one span has one name.

The index is built from the templates, a fixed list, and is broadcast with the code.

Defined cases: null, empty or word-less text reports nothing; a template found several
times is reported each time; null doc_id stays null; repeated rows are reported each.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .common import byte_bound

GRAM, WINNOW, BAND, MIN_COVERAGE = 3, 4, 12, 0.75


class Template(NamedTuple):
    license: str
    form: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE_2 = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."


def _gnu(name: str, version: str, kind: str) -> list[Template]:
    """Notice and statement of one of the GNU licenses."""
    words = f"version {version}".replace(".", " ")
    never = tuple(w for w in ("lesser", "affero", "library") if w not in kind.lower())
    full = f"GNU {kind}General Public License"
    must = (full.lower(), words)
    never += ("1",) if version == "2" else ()
    return [
        Template(name, "notice", f"you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", must, never),
        Template(name, "notice", f"you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation; version {version} of the License.", must, never),
        Template(name, "statement", f"licensed under the {full}, version {version}.", must, never),
    ]


def _creative(parts: tuple[str, ...], version: str) -> list[Template]:
    """Long and short statement of one Creative Commons license."""
    short = {"Attribution": "BY", "NonCommercial": "NC", "ShareAlike": "SA", "NoDerivatives": "ND"}
    code = "-".join(short[p] for p in parts)
    where = "International" if version == "4.0" else "Unported"
    name = f"CC-{code}-{version}"
    number = version.replace(".", " ")
    return [
        Template(name, "statement", f"licensed under a Creative Commons {'-'.join(parts)} {version} {where} License.", (f"creative commons {' '.join(parts)} {number}".lower(),)),
        Template(name, "statement", f"Licensed under CC {code} {version}.", (f"cc {code.replace('-', ' ')} {number}".lower(),)),
    ]


#: Public license texts, the notices that name them and the short statements that refer to them.
TEMPLATES: list[Template] = [
    Template("MIT", "text", _MIT + " " + _WARRANTY, ("any person obtaining a copy of this software",)),
    Template("MIT", "text", _MIT, ("any person obtaining a copy of this software",)),
    Template("MIT", "statement", "Released under the MIT License.", ("mit license",)),
    Template("MIT", "statement", "Licensed under the MIT License.", ("mit license",)),
    Template("Apache-2.0", "notice", _APACHE_2, ("apache license version 2 0",)),
    Template("Apache-2.0", "statement", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("Apache-1.1", "statement", "Licensed under the Apache Software License, Version 1.1.", ("version 1 1",)),
    Template("BSD-2-Clause", "text", _BSD_1 + " " + _BSD_END, ("redistributions of source code must retain", "redistributions in binary form must reproduce"), ("neither", "endorse", "acknowledgement", "acknowledgment")),
    Template("BSD-2-Clause", "conditions", _BSD_1, ("redistributions of source code must retain", "redistributions in binary form must reproduce"), ("neither", "endorse", "acknowledgement", "acknowledgment")),
    Template("BSD-3-Clause", "text", _BSD_1 + " " + _BSD_3 + " " + _BSD_END, ("redistributions in binary form must reproduce", "to endorse or promote products"), ("acknowledgement", "acknowledgment")),
    Template("BSD-3-Clause", "conditions", _BSD_1 + " " + _BSD_3, ("redistributions in binary form must reproduce", "to endorse or promote products"), ("acknowledgement", "acknowledgment")),
    Template("ISC", "text", _ISC + _ISC_KEEP + " " + _ISC_END, ("provided that the above copyright notice",)),
    Template("ISC", "text", _ISC + _ISC_KEEP, ("provided that the above copyright notice",)),
    Template("0BSD", "text", _ISC + ". " + _ISC_END, ("with or without fee is hereby granted the software is provided",)),
    Template("Zlib", "text", _ZLIB, ("altered source versions must be plainly marked",)),
    Template("BSL-1.0", "text", _BOOST, ("any person or organization",)),
    Template("Unlicense", "text", _UNLICENSE, ("released into the public domain",)),
    Template("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("MPL-1.1", "notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", ("mozilla public license version 1 1",)),
    Template("EPL-1.0", "notice", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ("eclipse public license v1 0",)),
    Template("EPL-2.0", "notice", "made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2 0",)),
    Template("CC0-1.0", "statement", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    *(t for name, version, kind in (("GPL-2.0", "2", ""), ("GPL-3.0", "3", ""), ("LGPL-2.1", "2.1", "Lesser "), ("LGPL-3.0", "3", "Lesser "), ("AGPL-3.0", "3", "Affero ")) for t in _gnu(name, version, kind)),
    *(t for version in ("3.0", "4.0") for parts in (("Attribution",), ("Attribution", "ShareAlike"), ("Attribution", "NoDerivatives"), ("Attribution", "NonCommercial"), ("Attribution", "NonCommercial", "ShareAlike"), ("Attribution", "NonCommercial", "NoDerivatives")) for t in _creative(parts, version)),
]


def _words_of(text: str):
    buf, offs = tc.text_bytes(pa.array([text], pa.large_string()))
    return tc.words(buf, offs, tc.class_table(tc.ALNUM), tc.fold_table())


def winnow(grams: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the least hash (the rightmost of equals) in each window; of a shorter list, its least."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else []
    out: list[int] = []
    for i in range(len(grams) - window + 1):
        part = grams[i : i + window]
        at = i + window - 1 - int(np.argmin(part[::-1]))
        if not out or out[-1] != at:
            out.append(at)
    return out


class Index(NamedTuple):
    places: dict[int, list[tuple[int, int]]]  # fingerprint -> (template, place)
    own: list[list[int]]  # word hashes by template
    must: list[list[list[int]]]
    never: list[set[int]]
    known: np.ndarray


def build_index(templates: list[Template]) -> Index:
    places: dict[int, list[tuple[int, int]]] = {}
    hashes = lambda text: _words_of(text)[0].tolist()
    for number, t in enumerate(templates):
        h = _words_of(t.text)[0]
        if len(h) < GRAM:
            raise ValueError(f"a template of fewer than {GRAM} words: {t.text!r}")
        grams = tc.ngrams(h, GRAM)
        for place in winnow(grams):
            places.setdefault(int(grams[place]), []).append((number, place))
    return Index(places, [hashes(t.text) for t in templates], [[hashes(p) for p in t.must] for t in templates], [{hashes(w)[0] for w in t.never} for t in templates], np.array(sorted(places), np.uint64))


def align(text: list[int], template: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order within `band` of the diagonal text = template + shift, and the span (first, last + 1) in the text.

    Among equal matches the shortest span counts, then the first.
    """
    n, m = len(text), len(template)
    # row[d] for text place template + shift + d: (matched, span start); of equal matches the latest start, as the end is still open
    width = 2 * band + 1
    none = (0, -1)
    row = [none] * (width + 1)
    top = (0, 0, 0)  # (matched, -length, -start)
    for i in range(m):
        new = [none] * (width + 1)
        for d in range(width):
            at = i + shift + d - band
            best = max(row[d + 1] if d + 1 < width else none, new[d - 1] if d else none)
            if 0 <= at < n and text[at] == template[i]:
                # row[d] is the best of the template words before i and the text words before `at`
                matched, start = row[d]
                found = (matched + 1, start if matched else at)
                top = max(top, (found[0], found[1] - at - 1, -found[1]))
                best = max(best, found)
            else:
                best = max(best, row[d])
            new[d] = best
        row = new
    matched, length, start = top
    return matched, -start, -start - length


def _holds(words: list[int], phrase: list[int]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def judge(index: Index, number: int, words: list[int], matched: int) -> bool:
    """Whether an aligned span of text words counts as the template."""
    return matched >= MIN_COVERAGE * len(index.own[number]) and all(_holds(words, p) for p in index.must[number]) and index.never[number].isdisjoint(words)


def best_names(found: list[tuple]) -> list[tuple]:
    """Of (template, matched, coverage, first, last) that overlap by more than half of the shorter, the one with more matched words."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[0], x[3])):
        if not any(2 * (min(x[4], y[4]) - max(x[3], y[3])) > min(x[4] - x[3], y[4] - y[3]) for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[3], x[0]))


def matches(h: np.ndarray, index: Index) -> list[tuple[int, int, float, int, int]]:
    """(template, matched words, coverage, first word, last word + 1) of one text's word hashes."""
    grams = tc.ngrams(h, GRAM)
    at = np.flatnonzero(np.isin(grams, index.known)) if len(grams) else []
    if not len(at):
        return []
    hits: dict[int, list[tuple[int, int]]] = {}
    for i in at.tolist():
        for number, place in index.places[int(grams[i])]:
            hits.setdefault(number, []).append((i - place, i))
    out = []
    for number, places in hits.items():
        template, tried = index.own[number], set()
        taken: list[tuple[int, int]] = []  # spans found so far, in order and apart
        for shift, i in sorted(places):
            while True:
                k = bisect_right(taken, (i, len(h)))
                if k and i < taken[k - 1][1]:
                    break  # a span found before holds this hit
                # the words between the spans beside it, so that a repeated statement is found by itself
                left, right = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(h)
                if (shift, left, right) in tried:
                    break
                tried.add((shift, left, right))
                low = max(left, shift - BAND)
                words = h[low : max(low, min(right, shift + len(template) + BAND + 1))].tolist()
                if not _enough(words, index, number):
                    break
                matched, first, last = align(words, template, shift - low)
                if not judge(index, number, words[first:last], matched):
                    break
                out.append((number, matched, matched / len(template), first + low, last + low))
                insort(taken, (first + low, last + low))
    return best_names(out)


def _enough(words: list[int], index: Index, number: int) -> bool:
    """A bound that costs less than an alignment: the template's words that occur at all, and its phrases."""
    here = set(words)
    template = index.own[number]
    return sum(w in here for w in template) >= MIN_COVERAGE * len(template) and all(_holds(words, p) for p in index.must[number])


def _scan(templates: list[Template]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(templates)
        word, fold = tc.class_table(tc.ALNUM), tc.fold_table()
        names = ["doc_id", "license", "form", "n_matched", "coverage", "start", "end", "span_text"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            buf, offs = tc.text_bytes(batch.column("text"))
            rows: list[tuple] = []
            for a, b in tc.row_groups(offs):
                h, s, e, wo = tc.words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], word, fold)
                for i in range(a, b):
                    p, q = int(wo[i - a]), int(wo[i - a + 1])
                    for number, matched, coverage, first, last in matches(h[p:q], index):
                        raw = buf[offs[i] : offs[i + 1]].tobytes()
                        base = offs[i] - offs[a]
                        x, y = int(s[p + first] - base), int(e[p + last - 1] - base)
                        start = len(raw[:x].decode("utf-8", "replace"))
                        span = raw[x:y].decode("utf-8", "replace")
                        rows.append((ids[i], *templates[number][:2], matched, coverage, start, start + len(span), span))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per license found: doc_id, license, form, n_matched, coverage, start and end (code points), span_text."""
    byte_bound(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES), "doc_id long, license string, form string, n_matched long, coverage double, start long, end long, span_text string")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "license", "form", "n_matched", F.round("coverage", 6).alias("coverage"), "start", "end")
