"""Licence scans with a generalised suffix automaton.

All licence templates and base phrases are put, as word sequences, into one generalised suffix automaton. A text is
streamed through it and gives matching statistics: for every word the longest run ending there that is a substring of
some template. Maximal long runs, and whole templates inside them, are chained, in order and with small gaps, into covered spans of a template; a
template whose words are covered enough gives its label. Base phrases are templates too: a place where one ends is
read from the automaton (its state is on the suffix-link path of the current one).

Speed: words are hashed in bulk; only chains of word pairs that stand in some template are walked.

Edge cases: null text is empty; no words: counts 0, null places, empty labels, score 0; very long texts are streamed.
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._spark import text_of
from tessera.llm._text import ALNUM, U, Words, chunks

# Base phrases with their labels, and public licence notices with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
)
MIN_RUN = 3
MAX_GAP = 4
COVERED = 0.75


def split(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM)
    return [w.text(i) for i in range(len(w.start))]


class Automaton:
    """Generalised suffix automaton over word numbers; ``places[v]`` are (template, end) of all occurrences of state v."""

    def __init__(self, templates: list[list[str]], phrases: list[tuple[list[str], str]]):
        self.templates = [*templates, *(p for p, _ in phrases)]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.templates for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        at: list[tuple[int, int, int]] = []  # state, template, end
        for k, t in enumerate(self.templates):
            last = 0
            for j, w in enumerate(t):
                last = self._add(last, self.vocab[w])
                at.append((last, k, j + 1))
        # a split may have cloned states since: an occurrence belongs to all states on the suffix path of its own
        own: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for v, k, j in at:
            own[v].add((k, j))
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__, reverse=True):
            own[self.link[v]] |= own[v]
        self.places = [sorted(x) for x in own]
        self.places[0] = []
        ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for i, (p, _) in enumerate(phrases):
            v = 0
            for w in p:
                v = self.next[v][self.vocab[w]]
            ends[v].append((len(p), i))
        whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for v, k, j in at:
            if j == len(self.templates[k]) and k < len(templates):
                whole[v].append((j, k))
        #: phrases, and whole templates, that end in a state: (length, number)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.ends[v] = (*ends[v], *self.ends[self.link[v]])
            self.whole[v] = (*whole[v], *self.whole[self.link[v]])
        n = len(self.vocab)
        self.pairs = np.unique([self.vocab[a] * n + self.vocab[b] for t in self.templates for a, b in zip(t, t[1:], strict=False)]).astype(np.int64)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def statistics(self, word_ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) at each word."""
        v = length = 0
        for c in word_ids:
            while v and c not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                length += 1
            else:
                v = length = 0
            yield v, length


@cache
def default_automaton() -> Automaton:
    return Automaton([split(t) for _, t in TEMPLATES], [(split(p), label) for p, label in BASE])


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    out = Words(np.frombuffer(b"".join(raw), np.uint8), off, np.ones(256, bool))
    return out.hash


def scan_words(ids: np.ndarray, a: Automaton, n_templates: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """ids: word numbers of one text, -1 for words in no template. Base places (start, phrase) and maximal runs
    (template, first word in the text, first word in the template, length)."""
    places, runs, whole = [], [], []
    n = len(a.vocab)
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    code = np.where(ok, ids[:-1].astype(np.int64) * n + ids[1:], -1)
    at = np.searchsorted(a.pairs, code)
    at[at == len(a.pairs)] = 0
    hit = np.flatnonzero(ok & (a.pairs[at] == code))
    if not len(hit):
        return places, runs
    cuts = np.flatnonzero(np.diff(hit) > 1)
    for i, j in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(hit) - 1])), strict=True):
        first, last = int(hit[i]), int(hit[j]) + 1
        before = (0, 0)
        for k, (v, length) in enumerate(a.statistics(ids[first : last + 1].tolist()), first):
            for size, phrase in a.ends[v]:
                if length >= size:
                    places.append((k - size + 1, phrase))
            for size, t in a.whole[v]:  # it may stand inside a longer run of another template
                if length >= size:
                    whole.append((t, k - size + 1, 0, size))
            if length <= before[1] and before[1] >= MIN_RUN:
                runs.append((*before, k - 1))
            before = (v, length)
        if before[1] >= MIN_RUN:
            runs.append((*before, last))
    return places, whole + [(t, end - length + 1, at - length, length) for v, length, end in runs for t, at in a.places[v] if t < n_templates]


def chain(runs: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """Chain runs of a template that follow each other in text and template, with gaps of at most MAX_GAP words; what
    overlaps the run before (a doubled word) is trimmed. For each stretch of the text the chain that covers most:
    (template, first word, last word, share covered)."""
    out = []
    by: dict[int, list[tuple[int, int, int]]] = {}
    for t, x, y, length in runs:
        by.setdefault(t, []).append((x, y, length))
    for t, found in sorted(by.items()):
        found.sort()
        best: list[tuple[int, int]] = []  # words covered by the best chain that ends with a run, and its first word
        near: list[int] = []  # runs that can still be followed
        for i, (x, y, length) in enumerate(found):
            near = [j for j in near if found[j][0] + found[j][2] + MAX_GAP >= x]
            here = (length, x)
            for j in near:
                u, v, before = found[j]
                trim = max(0, u + before - x, v + before - y)
                if trim < length and x + trim - u - before <= MAX_GAP and y + trim - v - before <= MAX_GAP:
                    here = max(here, (best[j][0] + length - trim, best[j][1]), key=lambda b: b[0])
            best.append(here)
            near.append(i)
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(found)), key=lambda i: (-best[i][0], found[i][0])):
            first, last = best[i][1], found[i][0] + found[i][2] - 1
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((t, first, last, best[i][0] / sizes[t]))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,covered:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: number of words, base places, labels, a score (best share of a template covered; 1 with a base phrase) and the covered template spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = default_automaton()
        sizes = [len(split(t)) for _, t in TEMPLATES]
        known = _hash_of(list(a.vocab))
        order = np.argsort(known)
        known_sorted, number = known[order], order.astype(np.int32)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])))])
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, _, raw, off in chunks(batch.column("text")):
                w = Words(raw, off, ALNUM)
                at = np.searchsorted(known_sorted, w.hash)
                at[at == len(known_sorted)] = 0
                ids = np.where(known_sorted[at] == w.hash, number[at], -1) if len(w.hash) else np.zeros(0, np.int32)
                rows = []
                for d in range(len(off) - 1):
                    mine = ids[w.first[d] : w.first[d + 1]]
                    places, runs = scan_words(mine, a, len(sizes)) if len(mine) > 1 else ([], [])
                    spans = [s for s in chain(runs, sizes) if s[3] >= COVERED]
                    base = sorted({BASE[p][1] for _, p in places})
                    labels = sorted({*base, *(TEMPLATES[s[0]][0] for s in spans)})
                    rows.append({
                        "doc_id": doc_ids[lo + d], "n_words": len(mine), "n_base": len(places), "first_word": min((p[0] for p in places), default=None), "last_word": max((p[0] for p in places), default=None),
                        "base_labels": ",".join(base), "labels": ",".join(labels), "score": 1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0)),
                        "spans": [{"label": TEMPLATES[t][0], "first_word": x, "last_word": y, "covered": min(1.0, c)} for t, x, y, c in spans],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return text_of(docs).mapInArrow(run, SCHEMA)
