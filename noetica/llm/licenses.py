"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template, as token sequences.  A file's
words are streamed through it to get matching statistics: at each word the length of the
longest template substring that ends there.  Maximal matches of MIN_MATCH words or more
are chained, per template, into spans of increasing template and file positions with
bounded gaps; the share of a template's words that its best chain covers is the score.
Templates reaching MIN_COVER give their label, unless words that tell licences apart (versions,
Affero, Lesser, ShareAlike, ...) are left out: a chain passes over none in the template or in the file.

Base phrases are found apart from that, at every place where their words stand in a row.

Cases: a null text is an empty one: no words, null places, empty labels, score 0.  Rows
are judged one by one, so ties and repeated rows get equal results and an empty table
gives an empty result.  Very long texts are scanned in one pass in time linear in their
words.  Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Licence texts, notices and headers as published by their authors: fixed values.  Labels are
#: those of PHRASES where these name a licence, else SPDX names in small letters.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    "lgpl-2.1": (
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "lgpl-3.0": (
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd-2-clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
    ),
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0.",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
}
#: Words that tell licences apart; so do versions, where a template states one.
NAMES = frozenset(b"affero lesser library nc sa nd noncommercial sharealike noderivatives noderivs".split())
VERSION = re.compile(rb"v?[0-9]{1,2}")
#: Shortest match that is chained, in words (a whole shorter template counts too).
MIN_MATCH = 3
#: Share of a template's words that a chain must cover to give its label.
MIN_COVER = 0.9
#: Most words left out between two matches of a chain, in the file and in the template.
MAX_GAP = 8

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TABLE[_b] = _b
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton over token ids (from 1); 0 is no token."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Per state: {sequence: ends of all occurrences of the state's strings in it}.
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, set()).add(i + 1)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for k, ends in self.ends[state].items():
                up.setdefault(k, set()).update(ends)

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, q, token)
        current, p = self._new(self.length[last] + 1), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = current
            p = self.link[p]
        if p == -1:
            self.link[current] = 0
        else:
            q = self.next[p][token]
            self.link[current] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return current

    def _split(self, p: int, q: int, token: int) -> int:
        half = self._new(self.length[p] + 1, like=q)
        self.link[q] = half
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = half
            p = self.link[p]
        return half

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match ending at each token."""
        state = length = 0
        out = []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        listed = [(label, words(t)) for label, ts in templates.items() for t in ts]
        self.labels = [label for label, _ in listed]
        self.sizes = [len(t) for _, t in listed]
        #: Per template: whether it states a version, and how many telling words stand before each place.
        self.versioned = [any(map(VERSION.fullmatch, t)) for _, t in listed]
        self.telling = [np.cumsum([0, *(w in NAMES or bool(VERSION.fullmatch(w)) for w in t)]).tolist() for _, t in listed]
        self.ids: dict[bytes, int] = {}
        for _, t in listed:
            for w in t:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.templates = [[self.ids[w] for w in t] for _, t in listed]
        self.automaton = Automaton(self.templates)
        #: Per state: (template, end) of its strings' occurrences, in order.
        self.places = [sorted((k, end) for k, ends in of.items() for end in ends) for of in self.automaton.ends]
        self.least = min([MIN_MATCH, *self.sizes])
        self.phrases = [(words(p), label) for p, label in phrases.items()]

    def base(self, text_words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
        places, labels = [], set()
        for phrase, label in self.phrases:
            at, size = -1, len(phrase)
            while True:
                try:
                    at = text_words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if text_words[at : at + size] == phrase:
                    places.append(at)
                    labels.add(label)
        return len(places), min(places, default=None), max(places, default=None), labels

    def matches(self, text_words: list[bytes]) -> list[tuple[int, int, int]]:
        """Maximal matches (start in the file, length, state), in order of their ends."""
        get = self.ids.get
        tokens = np.fromiter((get(w, 0) for w in text_words), np.int32, len(text_words))
        known = np.flatnonzero(tokens)
        if len(known) < self.least:
            return []
        out = []
        runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)
        for run in runs:
            if len(run) < self.least:
                continue
            stats = self.automaton.statistics(tokens[run[0] : run[-1] + 1].tolist())
            stats.append((0, 0))
            for i in range(len(stats) - 1):
                length, state = stats[i]
                if length >= self.least and stats[i + 1][0] <= length:
                    out.append((int(run[0]) + i + 1 - length, length, state))
        return out

    def passes(self, k: int, gap: list[bytes]) -> bool:
        """Whether a chain of template ``k`` may leave out these words of the file."""
        return not any(w in NAMES or (self.versioned[k] and VERSION.fullmatch(w)) for w in gap)

    def spans(self, text_words: list[bytes]) -> list[tuple[str, bool, float, int, int]]:
        """(label, no telling word left out, covered share, first word, end) of the best chain of each template met."""
        chains: dict[int, list[tuple[bool, int, int, int, int]]] = {}
        for start, length, state in self.matches(text_words):
            for k, end in self.places[state]:
                if length < min(MIN_MATCH, self.sizes[k]):
                    continue
                t0, own, telling = end - length, chains.setdefault(k, []), self.telling[k]
                # chains with all telling words so far go before longer ones
                best = (telling[t0] == 0, length, start, start + length, end)
                for whole, covered, first, f_end, t_end in reversed(own):
                    if f_end + MAX_GAP < start:  # chains lie in order of their ends: the rest is too far back
                        break
                    if not (0 <= start - f_end <= MAX_GAP and 0 <= t0 - t_end <= MAX_GAP and (whole, covered + length) > best[:2]):
                        continue
                    if telling[t_end] == telling[t0] and self.passes(k, text_words[f_end:start]):
                        best = (whole, covered + length, first, start + length, end)
                own.append(best)
        found = []
        for k, own in chains.items():
            ended = ((whole and self.telling[k][t_end] == self.telling[k][-1], covered, first, end) for whole, covered, first, end, t_end in own)
            whole, covered, first, end = max(ended, key=lambda c: (c[0] and c[1] >= MIN_COVER * self.sizes[k], c[1], -c[2]))
            found.append((self.labels[k], whole, covered / self.sizes[k], first, end))
        return found

    def scan(self, text: str | None) -> tuple:
        text_words = words(text)
        n, first, last, base = self.base(text_words)
        best, given, score = {}, {}, float(n > 0)
        for label, whole, share, a, b in self.spans(text_words):
            score = max(score, share)
            own = given if whole and share >= MIN_COVER else best
            if share > own.get(label, (0.0,))[0]:
                own[label] = (share, a, b)
        labels, best = base | given.keys(), best | given
        spans = [(label, *best[label]) for label in sorted(labels & best.keys())]
        return len(text_words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


@cache
def scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


_FIELDS = (
    ("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()),
)
_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("cover", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
_PA_SPANS = pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: places, labels, score, and the spans of the templates."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t, _ in _FIELDS), T.StructField("spans", T.ArrayType(_SPAN))])
    types = [*(t for *_, t in _FIELDS), _PA_SPANS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for part, texts in pieces(batches, text_col):
            columns = [list(c) for c in zip(*map(own.scan, texts), strict=True)]
            columns[-1] = [[dict(zip(("label", "cover", "first_word", "end_word"), s, strict=True)) for s in spans] for spans in columns[-1]]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
