"""License scan: normalised text against licence templates by Dice coefficient over word bigrams.

Runs of words are candidates wherever they stand, across lines and within them, up to (2 - t) / t times
the words of a template; so are each line, each block of lines between blank ones and the whole text. A
candidate with a bigrams and a template with b can reach the threshold t only if b lies between
a * t / (2 - t) and a * (2 - t) / t, and only if they share b * t / (2 - t) bigrams. A run loses nothing
if it begins and ends with a bigram of the template, so only such runs are tried, and only where enough
of the template's bigrams lie near one another, which is nowhere in most texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import with_python

THRESHOLD = 0.8

#: Licence notices, fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[a-z0-9]+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:]))


def dice(a: set | frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """Templates by bigram, with the bounds of sizes that any of them can match."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.t = threshold
        self.templates = {k: bigrams(normalised(v)) for k, v in templates.items()}
        self.index: dict[tuple, list[str]] = {}
        for k, grams in self.templates.items():
            for g in grams:
                self.index.setdefault(g, []).append(k)
        #: Words of the longest run that is tried, and shared bigrams that a match needs.
        self.reach = {k: int(len(normalised(v)) * (2 - threshold) / threshold) for k, v in templates.items()}
        self.need = {k: math.ceil(len(g) * threshold / (2 - threshold) - 1e-9) for k, g in self.templates.items()}
        self.words = {w for g in self.index for w in g}
        sizes = [len(g) for g in self.templates.values() if g]
        self.least = min(sizes) * threshold / (2 - threshold)
        self.most = max(sizes) * (2 - threshold) / threshold

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """Best template of a candidate at the threshold or above; of equal ones the first by name."""
        if len(words) - 1 < self.least:
            return None
        grams: set = set()
        for i in range(0, len(words), 500):  # a long candidate is over the bound soon
            grams.update(zip(words[i : i + 500], words[i + 1 : i + 501]))
            if len(grams) > self.most:
                return None
        a = len(grams)
        if a < self.least:
            return None
        low, high = a * self.t / (2 - self.t), a * (2 - self.t) / self.t
        near = {k for g in grams if g in self.index for k in self.index[g]}
        fit = [(-dice(grams, self.templates[k]), k) for k in near if low <= len(self.templates[k]) <= high]
        if fit and -min(fit)[0] >= self.t:
            d, k = min(fit)
            return k, -d
        return None

    def runs(self, words: list[str]) -> Iterator[tuple[int, int, str, float]]:
        """(first word, word after the last, template, dice) of the best runs by first word; of equal ones the longest."""
        grams = list(zip(words, words[1:]))
        places: dict[str, list[int]] = {}
        for i, g in enumerate(grams):
            if g in self.index:
                for k in self.index[g]:
                    places.setdefault(k, []).append(i)
        for k, at in places.items():
            template, need, reach = self.templates[k], self.need[k], self.reach[k]
            if len(at) < need:
                continue
            b, most = len(template), len(template) * (2 - self.t) / self.t
            for x, i in enumerate(at):
                last = min(i + reach - 1, len(grams))  # a run of so many words has one bigram less
                if bisect_left(at, last, x) - x < need:
                    continue
                seen: set = set()
                shared, best, end = 0, 0.0, 0
                for j in range(i, last):
                    g = grams[j]
                    hit = g in template
                    if g not in seen:
                        seen.add(g)
                        shared += hit
                        if len(seen) > most:
                            break
                    if hit and shared >= need and (d := 2 * shared / (len(seen) + b)) >= max(best, self.t):
                        best, end = d, j + 2
                if end:
                    yield i, end, k, best

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, line after the last, template, dice) of every candidate that matches.

        Of candidates with words in common the best stays, of equal ones the first, then the longest.
        """
        rows = [normalised(x) for x in text.split("\n")]
        # a line can match only if it has a word pair of a template; a block only if one of its lines or seams has
        marked = [not self.words.isdisjoint(r) for r in rows]
        if not any(marked):
            return []
        spans = {(i, i + 1) for i, m in enumerate(marked) if m}
        start = None
        for i, r in enumerate([*rows, []]):
            if r and start is None:
                start = i
            elif not r and start is not None:
                spans.add((start, i))
                start = None
        spans.add((0, len(rows)))
        words = [w for r in rows for w in r]
        line = [i for i, r in enumerate(rows) for _ in r]
        first = [0]
        for r in rows:
            first.append(first[-1] + len(r))
        found = list(self.runs(words))
        for a, b in spans:
            # distinct bigrams may be fewer than words, so only the lower bound prunes here
            if first[b] - first[a] - 1 < self.least or not any(marked[a:b]):
                continue
            if hit := self.best(words[first[a] : first[b]]):
                found.append((first[a], first[b], *hit))
        out: list[tuple[int, int, str, float]] = []
        taken = bytearray(len(words))
        for f in sorted(found, key=lambda x: (-x[3], x[0], -x[1], x[2])):
            if not any(taken[f[0] : f[1]]):
                taken[f[0] : f[1]] = b"\1" * (f[1] - f[0])
                out.append(f)
        return [(line[a], line[b - 1] + 1, k, d) for a, b, k, d in sorted(out)]


_matchers: dict[tuple, Matcher] = {}


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, found): one row per row of ``docs``; ``found`` holds (first_line, end_line, license, dice).

    A null or empty text has none, an empty table no rows. Rows are scanned one by one, so repeated rows repeat their
    result, null ids are carried, and other columns aren't read. Of equally good candidates the first, then the longest,
    then the first by template name stays; work grows with a text's words and the templates' lengths.
    """
    with_python(docs.sparkSession)
    pairs = tuple(sorted((templates or TEMPLATES).items()))
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("first_line", pa.int32()), ("end_line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (pairs, threshold) not in _matchers:
            _matchers[pairs, threshold] = Matcher(dict(pairs), threshold)
        matcher = _matchers[pairs, threshold]
        for batch in batches:
            made = [
                [dict(zip(("first_line", "end_line", "license", "dice"), f)) for f in matcher.scan(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, kind)], ["doc_id", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, found array<struct<first_line:int,end_line:int,license:string,dice:double>>"
    )


def op7_license_dice(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    best = F.array_max(F.transform("found", lambda x: x["dice"]))
    labels = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first_line"].cast("string"), x["end_line"].cast("string")))
    return scan_licenses(docs).select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(labels, ",").alias("licenses"),
        F.round(F.coalesce(best, F.lit(0.0)), 6).alias("best_dice"),
    )
