"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is wording with marks: `[[ ... ]]` may be absent, `{{a..b}}` stands for a to b words of any kind, and `{{x|y}}` for one
of the listed words; everything else is mandatory and must match word for word. A template becomes a line of states with
skips; a text is read word by word from every place where the template can start, and accepted at the
last state. The score tells how much wording there is: an accepted wording of n words gives 0.5 + n / 10, at most 1, a bare phrase n / 6, at most
0.5; the greatest counts.

Words are maximal runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters. Defined cases: null and empty texts have no words, no
labels and score 0; overlapping places all count; repeated rows and null ids are scanned like any other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import batch_of, slices_of, word_lists

#: Phrases that are labels by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

UNDER = "{{licensed|released|distributed|available}} under the [[terms of the]]"
#: Public license notices and texts as templates.
TEMPLATES = {
    "apache-2.0": ["{{licensed|released|distributed|available}} under the [[terms of the]] apache [[software]] license [[,]] version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "{{licensed|released|distributed|available}} under the [[terms of the]] MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the \"Software\")]], to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "{{licensed|released|distributed|available}} under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] , [[either]] version 3 [[of the License, or (at your option) any later version]]",
        "SPDX-License-Identifier: GPL-3.0 [[{{only|or}} [[later]] ]]",
    ],
    "gpl-2.0": ["{{licensed|released|distributed|available}} under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] , [[either]] version 2 [[of the License, or (at your option) any later version]]"],
    "lgpl": ["GNU {{lesser|library}} General Public License"],
    "lgpl-2.1": [
        "GNU Lesser General Public License [[as published by the Free Software Foundation]] , [[either]] version 2.1 [[of the License, or (at your option) any later version]]",
        "SPDX-License-Identifier: LGPL-2.1 [[{{only|or}} [[later]] ]]",
    ],
    "lgpl-3.0": [
        "GNU Lesser General Public License [[as published by the Free Software Foundation]] , [[either]] version 3 [[of the License, or (at your option) any later version]]",
        "SPDX-License-Identifier: LGPL-3.0 [[{{only|or}} [[later]] ]]",
    ],
    "agpl-3.0": ["GNU Affero General Public License"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "{{licensed|released}} under the [[terms of the]] Mozilla Public License [[, version]] 2.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "{{licensed|released|distributed}} under the [[terms of the]] [[{{2|3|new|simplified}} [[clause]] ]] BSD license",
    ],
    "bsd-2-clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY {{1..12}} AS IS",
        "SPDX-License-Identifier: BSD-2-Clause",
        "{{2|simplified}} [[clause]] BSD license",
    ],
    "bsd-3-clause": [
        "Neither the name of {{1..10}} nor the names of {{its|his|her|their|any}} contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
        "{{3|new|modified|revised}} [[clause]] BSD license",
    ],
    "isc": [
        "Permission to use, copy, modify, {{and}} [[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        UNDER + " ISC license",
        "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        UNDER + " zlib [[/libpng]] license",
        "SPDX-License-Identifier: Zlib",
    ],
    "epl-1.0": [UNDER + " Eclipse Public License [[, version]] [[v]] 1.0", "Eclipse Public License v1.0", "SPDX-License-Identifier: EPL-1.0"],
    "epl-2.0": [UNDER + " Eclipse Public License [[, version]] [[v]] 2.0", "Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "mit-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the \"Software\")]], to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{1..8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "apache-2.0-text": [
        "you may not use this {{file|software|work}} except in compliance with the License. You may obtain a copy of the License at [[{{http|https}} www.apache.org/licenses/LICENSE-2.0]] Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    ],
    "cc-by-4.0": ["{{licensed|released}} under [[a]] [[the]] CC BY 4.0", "{{licensed|released}} under a Creative Commons Attribution 4.0 [[International]] license"],
    "cc-by-nc-4.0": ["{{licensed|released}} under [[a]] [[the]] CC BY-NC 4.0", "{{licensed|released}} under a Creative Commons Attribution NonCommercial 4.0 [[International]] license"],
    "cc-by-sa-4.0": ["{{licensed|released}} under [[a]] [[the]] CC BY-SA 4.0", "{{licensed|released}} under a Creative Commons Attribution ShareAlike 4.0 [[International]] license"],
    "cc0": ["dedicated to the public domain", "CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "copyright-notice": ["Copyright [[(c)]] {{1..8}} all rights reserved"],
}
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MARK = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|[^\[\]{}]+|.")


def words_of(text: str) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """States in a row, as bits: bit i is set when the first i tokens of the template are behind."""

    def __init__(self, template: str):
        self.on: dict[str, int] = {}  # word -> states that it leads on from
        self.any = 0
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        n = 0
        for part in MARK.findall(template):
            if part == "[[":
                opened.append(n)
            elif part == "]]":
                skips.append((opened.pop(), n))
            elif part.startswith("{{") and (m := re.fullmatch(r"\{\{(\d+)\.\.(\d+)\}\}", part)):
                low, high = int(m[1]), int(m[2])
                for k in range(high):
                    self.any |= 1 << (n + k)
                skips += [(n + k, n + high) for k in range(low, high)]
                n += high
            elif part.startswith("{{"):
                for w in part[2:-2].split("|"):
                    if w:
                        self.on[w] = self.on.get(w, 0) | 1 << n
                n += 1
            else:
                for w in words_of(part):
                    self.on[w] = self.on.get(w, 0) | 1 << n
                    n += 1
        if opened:
            raise ValueError("an optional region is not closed")
        self.skips = sorted((1 << a, 1 << b) for a, b in skips if a < b)
        self.accepts = 1 << n
        self.start = self._closed(1)
        if self.start & (self.accepts | self.any):
            raise ValueError("a template needs mandatory wording at its start")
        self.first = {w for w, at in self.on.items() if at & self.start}

    def _closed(self, states: int) -> int:
        for a, b in self.skips:  # in order, so that one pass follows chains of skips
            if states & a:
                states |= b
        return states

    def match(self, words: list[str], at: int) -> int:
        """Place after the shortest accepted wording that starts at word `at`, or -1."""
        states = self.start
        while at < len(words):
            states = self._closed((states & (self.on.get(words[at], 0) | self.any)) << 1)
            at += 1
            if states & self.accepts:
                return at
            if not states:
                return -1
        return -1


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, all_of in TEMPLATES.items() for t in all_of]


def scan_column(texts: pa.Array) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, spans) of each text."""
    machines, out = automata(), []
    heads = {}
    for label, m in machines:
        for w in m.first:
            heads.setdefault(w, []).append((label, m))
    second = {w: set().union(*({x for x, at in m.on.items() if at & m._closed(((m.start & m.on[w]) << 1))} | ({None} if m._closed((m.start & m.on[w]) << 1) & m.any else set()) for _, m in ms)) for w, ms in heads.items()}
    for _, rows in slices_of(texts):
        met, which, per_text = word_lists(rows)
        number = {w: i for i, w in enumerate(met)}
        ends = np.cumsum(per_text)
        place_of = lambda at: np.searchsorted(ends, at, "right")
        base: dict[int, list[tuple[int, str, int]]] = {}
        for phrase, label in PHRASES.items():
            code = [number.get(w, -1) for w in phrase.split()]
            if min(code) < 0:
                continue
            at = np.flatnonzero(which == code[0])
            for k, c in enumerate(code):
                at = at[at + k < len(which)]
                at = at[which[at + k] == c]
            at = at[ends[place_of(at)] >= at + len(code)]
            for t, p in zip(place_of(at).tolist(), at.tolist()):
                base.setdefault(t, []).append((p, label, len(code)))
        tried: dict[int, list[tuple[int, str]]] = {}
        for w in heads:
            if w not in number:
                continue
            at = np.flatnonzero(which == number[w])
            at = at[at + 1 < len(which)]
            if None not in second[w]:
                at = at[np.isin(which[at + 1], [number[x] for x in second[w] if x in number])]
            for t, p in zip(place_of(at).tolist(), at.tolist()):
                tried.setdefault(t, []).append((p, w))
        for i in range(len(rows)):
            n, start = int(per_text[i]), int(ends[i] - per_text[i])
            places = sorted(p - start for p, _, _ in base.get(i, ()))
            labels = {x for _, x, _ in base.get(i, ())}
            spans = []
            if i in tried:
                words = [met[c] for c in which[start : start + n].tolist()]
                for p, w in tried[i]:
                    for label, m in heads[w]:
                        if (to := m.match(words, p - start)) >= 0:
                            spans.append((p - start, to, label))
            every = labels | {x for _, _, x in spans}
            score = max([min(1.0, 0.5 + (b - a) / 10) for a, b, _ in spans] + [min(0.5, k / 6) for _, _, k in base.get(i, ())], default=0.0)
            out.append((n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(sorted(every)), score, [f"{a}-{b}:{x}" for a, b, x in sorted(spans)]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (`first-after:label` in words). No shuffle."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    out = pa.schema([("doc_id", pa.int64()), *zip(names, kinds)])

    def run(batches):
        for b in batches:
            found = scan_column(b.column(1))
            yield batch_of(out, b.column(0).cast(pa.int64()), *([list(c) for c in zip(*found)] or [[]] * len(kinds)))

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")
