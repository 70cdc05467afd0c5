"""License notices in documents, by a generalised suffix automaton over the words of license templates.

All templates go into one automaton; every state knows its end places in each template. A text is streamed through it, which gives at
each word the longest run of words that ends there and stands in some template (matching statistics). Runs that cannot grow further
and have at least ``min_run`` words become matches; matches of one template, in order and near to each other, are chained, and a
chain that covers enough of the template gives its label. Words outside the templates' vocabulary end every run, so only stretches of
``min_run`` known words and more are streamed.

The base labels come from three phrases, each counted at all its places whatever the automaton says.

Edge cases: a NULL or empty text has no words, no places and no labels; repeated notices count once for a label and at each place for
the base; an empty table gives an empty result. The result column replaces an input column of the same name; other columns pass.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from samewise.llm import textbytes as tb
from samewise.llm.automaton import SuffixAutomaton

# The phrases of the base and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices and short licenses as their authors give them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

MIN_RUN = 4  # words of a match
MIN_COVERED = 0.8  # of a template, by one chain
MAX_GAP = 12  # words of the text between two matches of a chain
FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)
FOUND_SQL = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,labels:array<string>,score:double,"
    "spans:array<struct<label:string,start:bigint,end:bigint,score:double>>>"
)


class Match(NamedTuple):
    """Words start:end of the text stand in the template up to word ``place`` of it, exclusive, for each of the places in order."""

    template: int
    start: int
    end: int
    places: tuple[int, ...]


class Automaton(SuffixAutomaton):
    """Each state knows the end places of its runs in each template, in order."""

    def __init__(self, templates: list[list[int]]) -> None:
        super().__init__()
        ends = [self.add(words) for words in templates]
        found: list[dict[int, set[int]]] = [{} for _ in self.next]
        for t, states in enumerate(ends):
            for i, s in enumerate(states):
                found[s].setdefault(t, set()).add(i + 1)
        for s in self.longest_first():
            for t, its in found[s].items():
                found[self.link[s]].setdefault(t, set()).update(its)
        self.places = [{t: tuple(sorted(its)) for t, its in x.items()} for x in found]

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """At each word, the longest run ending there that stands in a template, and its state."""
        state = size = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            out.append((size, state))
        return out

    def matches(self, words: list[int], at: int, min_run: int) -> list[Match]:
        """The runs of at least min_run words that do not go on at the next word; ``at`` is the text's number of the first word."""
        found, stats = [], self.statistics(words)
        for i, (size, state) in enumerate(stats):
            if size >= min_run and (i + 1 == len(stats) or stats[i + 1][0] <= size):
                found += [Match(t, at + i + 1 - size, at + i + 1, places) for t, places in self.places[state].items()]
        return found


class Library:
    """Templates and phrases, ready for search."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_run: int = MIN_RUN) -> None:
        spelled = [(label, _tokens(text)) for label, texts in templates.items() for text in texts]
        self.labels = [label for label, _ in spelled]
        self.sizes = [len(words) for _, words in spelled]
        based = [(label, _tokens(text)) for text, label in phrases.items()]
        self.known = sorted({w for _, words in [*spelled, *based] for w in words})
        ids = {w: i + 1 for i, w in enumerate(self.known)}
        self.automaton = Automaton([[ids[w] for w in words] for _, words in spelled])
        self.phrases = [(label, [ids[w] for w in words]) for label, words in based]
        self.min_run = min_run
        hashes = np.array([_hash(w) for w in self.known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1

    def numbers(self, w: tb.Words) -> np.ndarray:
        """The vocabulary number of each word; 0 for unknown ones."""
        slot = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        out = np.where(self.hashes[slot] == w.hash, self.ids[slot], 0)
        known = np.flatnonzero(out)
        sizes = np.array([0, *map(len, self.known)])
        out[known[(w.end - w.start)[known] != sizes[out[known]]]] = 0
        return out


def _tokens(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = tb.words(raw, np.array([0, len(raw)]), tb.ALNUM)
    return [w.word(i) for i in range(len(w.start))]


def _hash(word: bytes) -> int:
    return int(tb.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), tb.ALNUM).hash[0])


def chained(matches: list[Match], sizes: list[int], max_gap: int) -> list[tuple[int, int, int, float]]:
    """(template, start, end, covered part) of each template's chains: matches in the order of text and template, near to each other. A
    match goes on from the chain at the first of its places behind the chain's."""
    by_template: dict[int, list[Match]] = {}
    for m in matches:
        by_template.setdefault(m.template, []).append(m)
    out = []
    for t, found in by_template.items():
        start = end = place = covered = 0
        for m in sorted(found, key=lambda m: (m.start, m.end)):
            size = m.end - m.start
            behind = bisect_right(m.places, place)
            if covered and m.start - end <= max_gap and behind < len(m.places):
                covered += min(size, m.places[behind] - place, max(0, m.end - end))
                end, place = max(m.end, end), m.places[behind]
            else:
                if covered:
                    out.append((t, start, end, covered / sizes[t]))
                start, end, place, covered = m.start, m.end, m.places[0], size
        if covered:
            out.append((t, start, end, covered / sizes[t]))
    return out


def scan(library: Library, data: np.ndarray, offsets: np.ndarray, min_covered: float = MIN_COVERED, max_gap: int = MAX_GAP) -> list[dict]:
    """What FOUND names, for each text."""
    w = tb.words(data, offsets, tb.ALNUM)
    ids = library.numbers(w)
    placed = []  # (word, phrase)
    for p, (_, words) in enumerate(library.phrases):
        n = len(ids) - len(words) + 1
        if n > 0:
            here = ids[:n] == words[0]
            for k, word in enumerate(words[1:], 1):
                here &= ids[k : n + k] == word
            placed.append(np.stack([at := np.flatnonzero(here), np.full(len(at), p)]))
    at, phrase = np.concatenate(placed, axis=1) if placed else np.zeros((2, 0), np.int64)
    text = np.searchsorted(w.first, at, "right") - 1
    whole = at + np.array([len(words) for _, words in library.phrases])[phrase] <= w.first[text + 1]
    based: dict[int, list[tuple[int, int]]] = {}
    for d, a, p in zip(text[whole].tolist(), at[whole].tolist(), phrase[whole].tolist(), strict=True):
        based.setdefault(d, []).append((a - int(w.first[d]), p))
    matched: dict[int, list[Match]] = {}
    known = ids > 0
    cuts = np.unique(w.first[(w.first > 0) & (w.first < len(ids))])
    starts, ends = tb.spans_of(known)
    inner = cuts[known[cuts] & known[cuts - 1]] if len(cuts) else cuts
    starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    long = ends - starts >= library.min_run
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        d = int(np.searchsorted(w.first, a, "right")) - 1
        if found := library.automaton.matches(ids[a:b].tolist(), a - int(w.first[d]), library.min_run):
            matched.setdefault(d, []).extend(found)
    out = []
    for d in range(len(offsets) - 1):
        places = based.get(d, [])
        base = sorted({library.phrases[p][0] for _, p in places})
        spans = [(library.labels[t], a, b, min(1.0, part)) for t, a, b, part in chained(matched.get(d, []), library.sizes, max_gap) if part >= min_covered]
        out.append(
            {
                "n_words": int(w.first[d + 1] - w.first[d]),
                "n_base": len(places),
                "first_word": min((a for a, _ in places), default=None),
                "last_word": max((a for a, _ in places), default=None),
                "base_labels": base,
                "labels": sorted({*base, *(s[0] for s in spans)}),
                "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
                "spans": [dict(zip(("label", "start", "end", "score"), s, strict=True)) for s in sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))],
            }
        )
    return out


def find(docs: DataFrame, text: str = "text", out: str = "license", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, min_run: int = MIN_RUN, min_covered: float = MIN_COVERED) -> DataFrame:
    """Add a struct with the counts, the labels and the spans of words that notices cover. The templates are a parameter, never a table."""
    shared = docs.sparkSession.sparkContext.broadcast(Library(templates or TEMPLATES, phrases or PHRASES, min_run))

    @arrow_udf(FOUND_SQL)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([row for _, _, data, offsets in tb.pieces(texts) for row in scan(shared.value, data, offsets, min_covered)], FOUND)

    return docs.withColumn(out, found(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("license")
    return find(docs).select(
        "doc_id",
        *[x[n].alias(n) for n in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(x["base_labels"], ",").alias("base_labels"),
        F.array_join(x["labels"], ",").alias("labels"),
        x["score"].alias("score"),
    )
