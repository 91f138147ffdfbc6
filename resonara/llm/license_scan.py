"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and license templates are sequences of lower-cased alphanumeric words and
so of 5-word shingles.  Windows have 2**k shingles; a template is kept by all
its windows of the largest such size it holds, a text by all its windows of
each size, at a stride of an eighth of it.  A band is one min-hash.  A text
becomes a template's candidate if a window of it and one of the template's have
equal keys in a band.

A verbatim copy has equal windows and is always found.  Where a share of 0.8 of
a template's shingles stands in a run of its length, a window pair has a
Jaccard similarity of 0.54 or more at the worst offset, and a miss of all
BANDS = 12 bands by one window pair has a probability below 1e-4.

A candidate is checked exactly: ``containment`` is the largest share of the
template's distinct shingles found in any run of as many shingles of the text,
and a run with at least CONTAINMENT matches.  Licenses that differ in a few
words contain most of each other, so two things more decide: a run must hold
one of its template's TELLING phrases, if it has any; and of matches whose runs
share more than half of the shorter one, the one with the most shingles of its
template stays, on ties that of the larger containment, then the first by name.

Templates are fixed and small, so they go to every task; the scan is one pass
over whole texts without a shuffle, and a row's cost follows its own length.

Defined results: a null, empty or wordless text matches nothing and gives no
row; a template of fewer than 5 words is refused, as it has no shingle; of equal
templates the first by name matches; a sentence matches whatever is said around
it, a denial too; repeated rows give repeated results; an empty table or no
templates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from resonara.llm.common import WordHashes, mixed, small_batches, utf8, window_hashes
from resonara.llm.decontamination import words_of

WIDTH = 5
BANDS = 12
CONTAINMENT = 0.8

# Disclaimers and conditions that several licenses have.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)


def _gnu(program: str, name: str, version: str, mark: str) -> str:
    return (
        f"{program} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        f"the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."
    )


# License names and the texts, notices or grants they are known by.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT,
    "MIT-text": f"{_MIT} {_AS_IS}",
    "BSD-grant": _BSD.replace("1. ", "").replace("2. ", "").strip(),
    "BSD-2-Clause-text": _BSD + _BSD_AS_IS,
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_AS_IS,
    "ISC-grant": _ISC,
    "ISC-text": (
        f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": _gnu("This program", "General Public License", "3", ":"),
    "GPL-2.0-notice": _gnu("This program", "General Public License", "2", ";"),
    "LGPL-3.0-notice": _gnu("This library", "Lesser General Public License", "3", ":"),
    "LGPL-2.1-notice": _gnu("This library", "Lesser General Public License", "2.1", ";"),
    "AGPL-3.0-notice": _gnu("This program", "Affero General Public License", "3", ":"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "EPL-1.0-notice": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
        "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
    ),
}

# Phrases of which a match has to hold one, where licenses differ in little else.
TELLING: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0",),
    "Apache-2.0-notice": ("Apache License Version 2.0",),
    "BSD-3-Clause-text": ("may be used to endorse or promote",),
    "GPL-3.0": ("General Public License, version 3",),
    "GPL-3.0-notice": ("GNU General Public",),
    "GPL-2.0-notice": ("GNU General Public",),
    "LGPL-3.0-notice": ("Lesser General Public",),
    "LGPL-2.1-notice": ("Lesser General Public",),
    "AGPL-3.0-notice": ("Affero General Public",),
    "MPL-2.0": ("Mozilla Public License v. 2.0",),
    "EPL-2.0-notice": ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "Eclipse Public License v2.0"),
    "EPL-1.0-notice": ("Eclipse Public License v1.0", "Eclipse Public License v. 1.0", "Eclipse Public License 1.0"),
    "CC-BY-4.0": ("Attribution 4.0",),
    "CC-BY-SA-4.0": ("ShareAlike 4.0",),
}
#: The version that a GNU notice names, which has to be its own.
VERSION = {"GPL-3.0-notice": "version 3", "GPL-2.0-notice": "version 2", "LGPL-3.0-notice": "version 3", "LGPL-2.1-notice": "version 2.1", "AGPL-3.0-notice": "version 3"}

_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mixed(np.arange(101, BANDS + 101, dtype=np.uint64)) | np.uint64(1)


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, telling: dict[str, tuple[str, ...]] | None = None, also: dict[str, str] | None = None):
        self.width = width
        self.hashes = WordHashes()
        self.names = sorted(templates)
        templates = {k: templates[k] for k in self.names}
        short = [k for k, t in templates.items() if len(words_of(t.encode())) < width]
        if short:
            raise ValueError(f"templates of fewer than {width} words: {', '.join(short)}")
        #: For each template, sets of phrases (as joined words) of which a run has to hold one each.
        phrase = lambda x: b" %s " % b" ".join(words_of(x.encode()))
        self.phrases = [[tuple(map(phrase, own)) for own in ((telling or {}).get(k, ()), ((also or {}).get(k),)) if own and own[0]] for k in self.names]
        self.sets = []
        #: (log of the window size, band) -> key -> templates.
        self.keys: dict[tuple[int, int], dict[int, set[int]]] = {}
        for k, text in enumerate(templates.values()):
            shingles = self.shingles(text.encode())
            self.sets.append(np.unique(shingles))
            if len(shingles):
                level = len(shingles).bit_length() - 1
                for band in range(BANDS if level else 1):
                    for low in self._minima(shingles, band, level)[: len(shingles) - (1 << level) + 1].tolist():
                        self.keys.setdefault((level, band), {}).setdefault(low, set()).add(k)
        self.levels = max((x for x, _ in self.keys), default=-1) + 1
        #: Which leading 16 bits a key may have.
        self.may = {x: np.zeros(1 << 16, bool) for x in self.keys}
        for x, own in self.keys.items():
            self.may[x][[low >> 48 for low in own]] = True

    def shingles(self, text: bytes) -> np.ndarray:
        return window_hashes(self.hashes.of(words_of(text)), self.width)

    @staticmethod
    def _minima(shingles: np.ndarray, band: int, level: int) -> np.ndarray:
        low = (shingles ^ _SEEDS[band]) * _ODD[band]
        for k in range(level):
            low = np.r_[np.minimum(low[: -(1 << k)], low[1 << k :]), low[-(1 << k) :]] if len(low) > 1 << k else low
        return low

    def candidates(self, shingles: np.ndarray, document: np.ndarray) -> set[tuple[int, int]]:
        """(document, template) pairs with an equal band key in a window.

        Windows go over the joined shingles of several documents; one that
        spans two of them can only add a candidate.
        """
        out: set[tuple[int, int]] = set()
        for band in range(BANDS):
            if not len(shingles):
                break
            low = (shingles ^ _SEEDS[band]) * _ODD[band]
            for level in range(self.levels):
                size = 1 << level
                if level and len(low) > size // 2:
                    low[: -(size // 2)] = np.minimum(low[: -(size // 2)], low[size // 2 :])
                if (level, band) not in self.keys:
                    continue
                stride = max(1, size // 8)
                at = low[::stride]
                for hit in np.flatnonzero(self.may[level, band][at >> np.uint64(48)]).tolist():
                    for k in self.keys[level, band].get(int(at[hit]), ()):
                        first = hit * stride
                        out.update((int(d), k) for d in set(document[first : first + size].tolist()))
        return out

    def check(self, shingles: np.ndarray, template: int) -> tuple[float, int, int]:
        """Largest containment in a run as long as the template, and the first and last shingle of the first such run."""
        own = self.sets[template]
        at = np.searchsorted(own, shingles)
        at[at == len(own)] = 0
        number = np.where(own[at] == shingles, at, -1) if len(own) else np.full(len(shingles), -1)
        places = np.flatnonzero(number >= 0)
        best, run, begin = 0, (0, 0), 0
        counts: dict[int, int] = {}
        for place in places.tolist():
            counts[int(number[place])] = counts.get(int(number[place]), 0) + 1
            while places[begin] <= place - len(own):
                old = int(number[places[begin]])
                counts[old] -= 1
                if not counts[old]:
                    del counts[old]
                begin += 1
            if len(counts) > best:
                best, run = len(counts), (int(places[begin]), place)
        return (best / len(own) if len(own) else 0.0), *run

    def found(self, text: bytes, shingles: np.ndarray, candidates: list[int], containment: float) -> list[tuple[str, float, int]]:
        """Name, containment and first word of the candidates that match, the best where their runs meet."""
        held, words = [], None
        for k in candidates:
            share, first, last = self.check(shingles, k)
            if share < containment:
                continue
            if self.phrases[k]:
                words = words_of(text) if words is None else words
                run = b" %s " % b" ".join(words[first : last + self.width])
                if not all(any(p in run for p in own) for own in self.phrases[k]):
                    continue
            held.append((-round(share * len(self.sets[k])), -share, self.names[k], first, last))
        out: list[tuple[str, float, int, int]] = []
        for _, share, name, first, last in sorted(held):
            if all(2 * (min(last, z) - max(first, a) + 1) <= min(last - first, z - a) + 1 for _, _, a, z in out):
                out.append((name, -share, first, last))
        return sorted((name, share, first) for name, share, first, _ in out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, telling: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id, license, containment and first_word of every license found in a text; without ``templates`` those known here, with their telling phrases."""
    small_batches(docs.sparkSession)
    docs = docs.select(id_column, text)
    known = (TEMPLATES, WIDTH, TELLING, VERSION) if templates is None else (templates, WIDTH, telling)
    Scanner(*known)  # refuses templates here rather than in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*known)
        for batch in batches:
            raw = utf8(batch.column(1))
            texts = [scanner.shingles(t) for t in raw]
            rows: list[tuple[int, str, float, int]] = []
            begin = 0
            while begin < len(texts):
                size, end = 0, begin
                while end < len(texts) and (end == begin or size + len(texts[end]) <= 1 << 17):
                    size += len(texts[end])
                    end += 1
                document = np.repeat(np.arange(begin, end), [len(x) for x in texts[begin:end]])
                met: dict[int, list[int]] = {}
                for d, k in sorted(scanner.candidates(np.concatenate(texts[begin:end]), document)):
                    met.setdefault(d, []).append(k)
                for d, own in met.items():
                    rows += [(d, *x) for x in scanner.found(raw[d], texts[d], own, containment)]
                begin = end
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], [id_column, "license", "containment", "first_word"])

    return docs.mapInArrow(run, f"`{id_column}` {docs.schema[0].dataType.simpleString()}, license string, containment double, first_word long")
