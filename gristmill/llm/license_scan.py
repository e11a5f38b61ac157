"""License scans by conditional compression and exact wording.

1. Candidate blocks. If at most d words of a template may differ, any d + 1 of its words cannot all be missing. The
   longest d + 1 of each template are its anchors; wherever a text has one of them, the block around it on which the
   template would lie is a candidate. No passage within the bound has no block (tests hold that against brute force).
2. Each block is compressed alone and with the block's templates as raw zstandard dictionaries; size reductions rank
   the candidates, largest first.
3. In this order each is aligned word by word with its template (least number of words replaced, left out or put in,
   free ends). It is confirmed if at most d words differ and no number of the template does, since the number is what
   tells versions apart. Templates that fit the same words alike are ranked by what they take off that passage: the
   largest reduction that wording confirms takes the words, and what is left of the block is ranked anew.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from gristmill.llm.common import only

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Proprietary": "All rights reserved.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-full": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law.""",
    "BSL-1.0-full": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following""",
    "MPL-2.0-full": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Wordings that several licences share but for a clause or a name.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. {clause}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ENDORSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. """
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} for more details."""
TEMPLATES |= {"BSD-2-Clause-full": BSD.format(clause=""), "BSD-3-Clause-full": BSD.format(clause=ENDORSE)}
TEMPLATES |= {
    f"{short}-{version}-notice": GNU.format(name=name, version=number)
    for short, name, version, number in (
        ("GPL", "General Public License", "2.0", "2"), ("GPL", "General Public License", "3.0", "3"), ("LGPL", "Lesser General Public License", "2.1", "2.1"),
        ("LGPL", "Lesser General Public License", "3.0", "3"), ("AGPL", "Affero General Public License", "3.0", "3"),
    )
}
WORD = re.compile(r"[a-z]+|\d+")
#: The most words, as a share of the template's, that may differ from it.
MOST_DIFFERENT = 0.15
#: Words of a block that are aligned at once; longer blocks are cut with overlaps that hold any passage.
SPAN = 4096
FINDINGS = "doc_id long, line long, license string, gain double, n_differences int, differences string"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.most = int(MOST_DIFFERENT * len(self.words))
        self.counts = Counter(self.words)
        #: anchor -> its first place in the template
        self.anchors: dict[str, int] = {}
        for w in sorted(self.counts, key=lambda w: (w.isdigit(), -len(w), w))[: self.most + 1]:
            self.anchors[w] = self.words.index(w)
        self.places = self.anchors if len(self.anchors) > self.most else {w: self.words.index(w) for w in self.counts}
        self.never = self.most + 1  # a cost that no confirmed passage has

    def aligned(self, have: list[str]) -> list[tuple[int, int, int, str]]:
        """(first, end, number of differences, differences) of the passages within the bound that do not overlap, the
        closest first. ``have``: at most SPAN words."""
        if (self.counts - Counter(have)).total() > self.most:
            return []
        n, m = len(self.words), len(have)
        numbers = {w: k for k, w in enumerate(dict.fromkeys([*self.words, *have]))}
        text = np.array([numbers[w] for w in have], np.int32)
        digits = np.array([w.isdigit() for w in have], bool)
        cost = np.zeros((n + 1, m + 1), np.int32)
        steps = np.arange(m + 1)
        for i, w in enumerate(self.words, 1):
            exact = w.isdigit()
            replace = np.where(text == numbers[w], 0, self.never if exact else np.where(digits, self.never, 1))
            over = cost[i - 1] + (self.never if exact else 1)
            over[1:] = np.minimum(over[1:], cost[i - 1, :-1] + replace)
            cost[i] = steps + np.minimum.accumulate(over - steps)  # words of the text that the template lacks
        out, free = [], [(0, m)]
        ends = np.flatnonzero(cost[n] <= self.most)
        for end in ends[np.lexsort((ends, cost[n, ends]))].tolist():
            first, apart = self._back(cost, have, end)
            if any(a <= first and end <= b for a, b in free):
                out.append((first, end, int(cost[n, end]), apart))
                free = [p for a, b in free for p in ([(a, first), (end, b)] if a <= first and end <= b else [(a, b)])]
        return out

    def _back(self, cost: np.ndarray, have: list[str], end: int) -> tuple[int, str]:
        """Where the passage that ends there begins, and the words that differ."""
        i, j, apart = len(self.words), end, []
        while i:
            w = self.words[i - 1]
            free = self.never if w.isdigit() else 1
            if j:
                t = have[j - 1]
                replace = 0 if t == w else self.never if w.isdigit() or t.isdigit() else 1
                if cost[i, j] == cost[i - 1, j - 1] + replace:
                    if replace:
                        apart.append(f"{w}>{t}")
                    i, j = i - 1, j - 1
                    continue
                if cost[i, j] == cost[i, j - 1] + 1:
                    apart.append(f">{t}")
                    j -= 1
                    continue
            assert cost[i, j] == cost[i - 1, j] + free
            apart.append(f"{w}>")
            i -= 1
        return j, ";".join(reversed(apart))


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = [Template(k, t) for k, t in sorted((templates or TEMPLATES).items()) if words(t)]
        plain = dict(write_checksum=False, write_content_size=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(level=3, **plain)
        raw = lambda t: zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {t.name: zstandard.ZstdCompressor(level=3, dict_data=raw(t), **plain) for t in self.templates}
        self.anchored: dict[str, list[tuple[Template, int]]] = defaultdict(list)
        for t in self.templates:
            for w, k in t.places.items():
                self.anchored[w].append((t, k))
        self.gate = re.compile("|".join(sorted(map(re.escape, self.anchored), key=lambda w: (-len(w), w))))

    def blocks(self, have: list[str]) -> dict[str, list[tuple[int, int]]]:
        """For each template the blocks of words that a passage of it can only lie in."""
        around: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(have):
            for t, k in self.anchored.get(w, ()):
                around[t.name].append((max(0, at - k - t.most), min(len(have), at - k + len(t.words) + t.most)))
        out = {}
        for t in self.templates:
            joined: list[list[int]] = []
            for a, b in sorted(around.get(t.name, ())):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            step = SPAN - len(t.words) - t.most - 1
            out[t.name] = [(a, min(b, a + SPAN)) for x, b in joined for a in range(x, max(x + 1, b - (SPAN - step)), step)]
        return out

    def saved(self, block: list[str], name: str) -> tuple[int, float]:
        """Bytes that the template as a dictionary takes off a block's compressed size, and their share of it."""
        data = " ".join(block).encode()
        alone = len(self.alone.compress(data))
        less = alone - len(self.given[name].compress(data))
        return less, less / alone

    def confirmed(self, have: list[str]) -> list[tuple[int, int, str, int, str, float]]:
        """(first, end, template, number of differences, differences, gain) of all passages within the bound, those of
        different templates that overlap too."""
        around, out = self.blocks(have), {}
        for t in self.templates:
            for a, b in around[t.name]:
                for first, end, n, apart in t.aligned(have[a:b]):
                    if end > first:
                        out[a + first, a + end, t.name] = (n, apart, self.saved(have[a:b], t.name)[1])
        return [(first, end, name, *rest) for (first, end, name), rest in out.items()]

    def windows(self, around: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
        """(first, end, own end): the blocks of all templates joined where they overlap, and cut at SPAN words. Windows
        of one stretch overlap by what the longest passage takes; each is to find the passages that begin before its
        own end."""
        longest = max((len(t.words) + t.most for t in self.templates), default=0) + 1
        joined: list[list[int]] = []
        for a, b in sorted(x for blocks in around.values() for x in blocks):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            while b - a > SPAN:
                yield a, a + SPAN, a + SPAN - longest
                a += SPAN - longest
            yield a, b, b

    def ranked(self, part: list[str], near: list[Template]) -> list[tuple[Template, float]]:
        """Templates and their gains by falling size reduction, of equal ones the shorter first."""
        told = [(t, *self.saved(part, t.name)) for t in near if len(t.words) - t.most <= len(part)]
        return [(t, gain) for t, _, gain in sorted(told, key=lambda c: (-c[1], len(c[0].words), c[0].name))]

    def settled(self, have: list[str]) -> list[tuple[int, int, str, int, str, float]]:
        """(first, end, template, number of differences, differences, gain) of passages that do not overlap.

        In each block templates are tried by falling size reduction until exact wording confirms one; where its closest
        passage lies, the templates are ranked again by what they take off that passage alone, and the first that is
        confirmed there takes the words. What is left of the block on both sides is ranked anew, until nothing in it is
        confirmed."""
        around, out, taken = self.blocks(have), [], 0
        for start, stop, own_end in self.windows(around):
            todo = [(max(start, taken), stop)]
            while todo:
                a, b = todo.pop()
                near = [t for t in self.templates if any(x < b and a < y for x, y in around[t.name])]
                for t, _ in self.ranked(have[a:b], near):
                    places = [p for p in t.aligned(have[a:b]) if p[0] < p[1] and a + p[0] < own_end]
                    if not places:
                        continue
                    x, y = a + places[0][0], a + places[0][1]
                    winners = ((w, gain, w.aligned(have[x:y])) for w, gain in self.ranked(have[x:y], near))
                    w, gain, found = next(c for c in winners if c[2] and c[2][0][0] < c[2][0][1])
                    first, end, n, apart = found[0]
                    out.append((x + first, x + end, w.name, n, apart, gain))
                    taken = max(taken, x + end)
                    todo += [(a, x + first), (x + end, b)]
                    break
        return sorted(out)

    def scan(self, text: str | None) -> list[tuple[int, str, float, int, str]]:
        """(line, licence, gain, number of differences, differences) of each settled passage, in their order."""
        if not isinstance(text, str) or not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.gate.search(low):
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        rows, line, seen = [], 0, 0
        for first, _, name, n, apart, gain in self.settled([low[a:b] for a, b in spans]):
            line += text.count("\n", seen, spans[first][0])
            seen = spans[first][0]
            rows.append((line, name, gain, n, apart))
        return rows


def findings(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each confirmed passage (FINDINGS); documents without any have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for frame in frames:
            rows = [(d, *f) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for f in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return only(docs, "doc_id", "text").mapInPandas(run, FINDINGS)


def license_report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_findings, licenses (distinct, sorted, comma-joined), n_differences and best_gain of every row.

    Null and empty texts have no findings; the gain of none is 0. Very long texts are read whole, in blocks. Of equally
    good passages that overlap, the first name stands. Repeated rows and rows without doc_id are rows of their own; an
    empty table gives an empty result; other columns are not looked at.
    """
    schema = "doc_id long, n_findings long, licenses string, n_differences long, best_gain double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for frame in frames:
            found = [scanner.scan(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "n_findings": [len(x) for x in found],
                    "licenses": [",".join(sorted({f[1] for f in x})) for x in found],
                    "n_differences": [sum(f[3] for f in x) for x in found],
                    "best_gain": np.array([max((f[2] for f in x), default=0.0) for x in found], float),
                }
            )

    return only(docs, "doc_id", "text").mapInPandas(run, schema)
