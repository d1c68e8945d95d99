"""Licence scans with a generalised suffix automaton of licence words.

All templates (notices of common licences, and the phrases that name one) go into one suffix automaton over
words. A text is streamed through it: the state and the matching statistic at each word say how many of
the last words stand together in some template, and where. Phrases are found where the statistic reaches
their length; matches of `seed` words or more, at every place that they have in a template, are chained along template
and text into spans by dynamic programming, and a template that enough of its words cover gives its label and the spans
of the text. Spans of one template do not overlap: the best chain goes first.

Only words of the templates can move the automaton off its root, so numpy finds the places that matter by
hash and the automaton walks over those alone. One narrow pass, no shuffle; the automaton's size is that of
the templates.

Defined results: null and empty texts have no words and no labels; rows repeat as they come; other columns are
not read unless named in `keep`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, text_slices

#: Phrases that name a licence, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording of common notices, by label.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
}


class SuffixAutomaton:
    """All stretches of words of several templates.

    next: transitions; link: the state of the longest suffix elsewhere; length: of the state's longest stretch;
    ends: for each template in which it occurs, the places of the last word of its occurrences, for states that stand for
    `least` words or more.
    """

    def __init__(self, templates: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, []).append(i)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= least:
                up = self.ends[self.link[s]]
                for t, places in self.ends[s].items():
                    up[t] = sorted({*up.get(t, ()), *places})

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        """The stretches of q that are as long as p's with w, as a state of their own."""
        r = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = r
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = r
            p = self.link[p]
        return r

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and how many of the last words it stands for."""
        s, n = 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                n = 0
            yield s, n


class Scanner:
    """The automaton of some templates and phrases (of two words or more), ready to scan batches of texts."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], seed: int, gap: int, cover: float):
        self.seed, self.gap, self.cover = seed, gap, cover
        self.labels = [*templates, *phrases.values()]
        self.n_templates = len(templates)
        data = [np.frombuffer(t.encode(), np.uint8) for t in (*templates.values(), *phrases)]
        words = [Words(d, np.array([0, len(d)])) for d in data]
        self.spelled = [[bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] for w in words]
        self.size = [len(x) for x in self.spelled]
        if min(self.size[self.n_templates :], default=2) < 2:
            raise ValueError("a phrase has two words at least")
        self.vocabulary = sorted({x for t in self.spelled for x in t})
        number = {x: i for i, x in enumerate(self.vocabulary)}
        coded = [[number[x] for x in t] for t in self.spelled]
        self.automaton = a = SuffixAutomaton(coded, seed)
        self.keys, at = np.unique(np.concatenate([w.hashes() for w in words]), return_index=True)
        self.number = np.array([i for t in coded for i in t], np.int64)[at]
        self.may = np.zeros(1 << 16, bool)  # by the top bits of a hash
        self.may[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.pair = np.zeros((len(number), len(number)), bool)  # words that follow each other in a template
        for t in coded:
            self.pair[t[:-1], t[1:]] = True
        own: dict[int, list[tuple[int, int]]] = {}
        for p in range(self.n_templates, len(coded)):
            s = 0
            for x in coded[p]:
                s = a.next[s][x]
            own.setdefault(s, []).append((self.size[p], p))
        # the phrases that stretches of each state can end in: its own, and those of its suffixes
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for s in sorted(range(len(a.link)), key=lambda s: a.length[s]):
            self.phrases[s] = own.get(s, []) + (self.phrases[a.link[s]] if a.link[s] >= 0 else [])

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number in the vocabulary or -1, and first and last words of runs whose neighbours are neighbours in a template."""
        h = words.hashes()
        number = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.may[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        number[maybe[hit]] = self.number[at[hit]]
        link = np.zeros(len(h) + 1, bool)  # from word i to word i + 1
        if len(h) > 1:
            link[:-2] = (number[:-1] >= 0) & (number[1:] >= 0) & self.pair[number[:-1], number[1:]]
            link[words.splits[1:][words.splits[1:] > 0] - 1] = False  # the last word of a text
        before = np.append(False, link[:-1])
        return number, np.flatnonzero(link & ~before), np.flatnonzero(~link & before)

    def scan(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]]:
        """By text: phrase places (word, phrase), and by template the matches (word, place in the template, words)."""
        number, first, last = self.runs(words)
        texts = np.searchsorted(words.splits, first, "right") - 1
        out: dict[int, tuple[list, dict]] = {}
        for text, a, b in zip(texts.tolist(), first.tolist(), last.tolist()):
            at = a - int(words.splits[text])
            track = list(self.automaton.walk(number[a : b + 1].tolist()))
            for j, (s, n) in enumerate(track):
                for size, p in self.phrases[s]:
                    if n >= size and self.spells(words, a + j + 1 - size, self.spelled[p]):
                        out.setdefault(text, ([], {}))[0].append((at + j + 1 - size, p))
                if n >= self.seed and (j + 1 == len(track) or track[j + 1][1] <= n):
                    for t, ends in self.automaton.ends[s].items():
                        if t < self.n_templates:
                            out.setdefault(text, ([], {}))[1].setdefault(t, []).extend((at + j + 1 - n, end + 1 - n, n) for end in ends)
        return out

    @staticmethod
    def spells(words: Words, at: int, want: list[bytes]) -> bool:
        return all(bytes(words.data[words.starts[at + i] : words.ends[at + i]]) == w for i, w in enumerate(want))

    def chain(self, t: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """Chains of matches (word, place in the template, words): (first word, last word, share of the template covered).

        Of two matches that follow each other both ends of the later one lie further on, it adds the words that neither in
        text nor template overlap the earlier one, and at most `gap` words lie between. The chain with most words goes
        first; a later one ends where it would share text with one that is out.
        """
        found = sorted(found, key=lambda m: (m[0] + m[2], m[1] + m[2], m[2]))
        ends, before = [x + n for x, _, n in found], [-1] * len(found)
        words = [n for _, _, n in found]
        for i, (x, y, n) in enumerate(found):
            for j in range(bisect_left(ends, x - self.gap), bisect_left(ends, x + n)):
                shared = max(0, ends[j] - x, found[j][1] + found[j][2] - y)
                if shared < n and y + shared - found[j][1] - found[j][2] <= self.gap and x + shared - ends[j] <= self.gap and words[j] + n - shared > words[i]:
                    words[i], before[i] = words[j] + n - shared, j
        out: list[tuple[int, int, int]] = []  # first word, word behind the last, words covered
        for i in sorted(range(len(found)), key=lambda i: (-words[i], ends[i], i)):
            at = bisect_left(out, (ends[i],))
            floor = out[at - 1][1] if at else 0  # where the text is free before this match
            if found[i][0] < floor:
                continue
            first = i
            while before[first] >= 0 and found[before[first]][0] >= floor:
                first = before[first]
            covered = words[i] - (words[before[first]] if before[first] >= 0 else 0)
            out.insert(at, (found[first][0], ends[i], covered))
        return [(a, b - 1, covered / self.size[t]) for a, b, covered in out]


def load_templates(rows: DataFrame, most_bytes: int = 8 << 20) -> dict[str, str]:
    """Templates from a table of label and text, at most `most_bytes` of them: ValueError beyond that, or where a label repeats.

    Rows without label or words are left out; other columns are not read.
    """
    rows = rows.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label IS NOT NULL AND text RLIKE '[A-Za-z0-9\\\\x{80}-\\\\x{10FFFF}]'")
    size = rows.agg(F.count(F.lit(1)), F.count_distinct("label"), F.coalesce(F.sum(F.octet_length("text") + F.octet_length("label")), F.lit(0))).first()
    if size[0] != size[1] or size[2] > most_bytes:
        raise ValueError(f"{size[0]} templates with {size[1]} labels and {size[2]} bytes")
    return {r.label: r.text for r in rows.orderBy("label").collect()}


class Setup:
    """What a scan needs, as it travels to the executors; each Python worker builds the automaton once."""

    def __init__(self, *args):
        self.args, self.scanner = args, None

    def get(self) -> Scanner:
        if self.scanner is None:
            self.scanner = Scanner(*self.args)
        return self.scanner

    def __getstate__(self):
        return self.args

    def __setstate__(self, args):
        self.__init__(*args)


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType())])
SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType())])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, seed: int = 4, gap: int = 6, cover: float = 0.6) -> DataFrame:
    """doc_id, n_words, places (of phrases), spans (of covered templates, also in code points of the text), score.

    score: the largest share of a template that one chain of matches covers, 1 where a phrase stands.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Setup(templates, phrases, seed, gap, cover))  # of the templates' size
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value.get()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets)
                found = s.scan(w)
                places, spans, score = [[] for _ in range(len(part))], [[] for _ in range(len(part))], np.zeros(len(part))
                for i, (own, matches) in found.items():
                    places[i] = [{"label": s.labels[p], "first_word": at} for at, p in own]
                    chains = [(s.labels[t], *c) for t in sorted(matches) for c in s.chain(t, matches[t])]
                    score[i] = 1.0 if own else max([c[3] for c in chains], default=0.0)
                    chains = [c for c in chains if c[3] >= s.cover]
                    if chains:
                        points = np.append(0, np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80))
                        at = lambda edge, k: int(points[edge[w.splits[i] + k] - offsets[i]])  # noqa: B023, E731
                        spans[i] = [{"label": label, "first_word": a, "last_word": b, "start": at(w.starts, a), "end": at(w.ends, b), "covered": c} for label, a, b, c in chains]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(w.splits).astype(np.int64)), pa.array(places, place), pa.array(spans, span), pa.array(score)], names=["doc_id", "n_words", "places", "spans", "score"])

    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of what scan gives."""
    base = F.transform("places", lambda p: p["label"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.transform("places", lambda p: p["first_word"])
    both = F.concat(base, F.transform("spans", lambda p: p["label"]))
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names(base).alias("base_labels"), names(both).alias("labels"), "score")
