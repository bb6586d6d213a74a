"""License scans: Dice coefficient over word bigrams against license templates.

Texts and templates are normalised to lower-case words.  A window of a text matches a template if
twice the bigrams that they share, over the bigrams of both, reaches the threshold.  A window of n
bigrams can only reach threshold t against a template of m bigrams if t m / (2 - t) <= n <=
m (2 - t) / t: these size bounds prune templates and windows.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import DataFrame

from ._common import table

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Public licence notices, by SPDX identifier; <...> stands for words that vary and are left out.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 3.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}


#: Most characters of templates that ``templates_of`` takes to the driver.
MAX_TEMPLATE_CHARS = 20_000_000


def templates_of(df: DataFrame) -> dict[str, list[str]]:
    """Templates from a table (license, text), such as the full texts of licences, to be given to ``scan`` beside TEMPLATES or alone.

    Null names and texts are left out; more than MAX_TEMPLATE_CHARS characters are an error, as all tasks get them.
    """
    rows = df.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text").distinct()
    if (rows.agg({"text": "count"}).first()[0] or 0) and rows.selectExpr("sum(length(text))").first()[0] > MAX_TEMPLATE_CHARS:
        raise ValueError("too many characters of templates")
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("license", "text").collect():
        out.setdefault(r.license, []).append(r.text)
    return out


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bigrams(ws: list[str]) -> list[tuple[str, str]]:
    return list(zip(ws, ws[1:]))


class Scanner:
    """Templates with their bigram counts, and the bigrams that point to them."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        from collections import Counter

        self.t = threshold
        exact = Fraction(str(threshold))  # floats would cut off windows that just reach the threshold
        self.templates = []
        self.owners: dict[tuple[str, str], list[int]] = {}
        for name, notices in templates.items():
            for number, notice in enumerate(notices):
                grams = Counter(bigrams(words(notice)))
                m = sum(grams.values())
                if not m:
                    continue
                low, high = math.ceil(m * exact / (2 - exact)), math.floor(m * (2 - exact) / exact)
                self.templates.append((name, number, grams, m, low, high))
        # A window that reaches the threshold shares at least t (m + n) / 2 >= t m / (2 - t) bigrams, so it has one
        # of any set of template bigrams whose occurrences number more than m - t m / (2 - t); the
        # bigrams that the fewest templates have make that set.
        spread = Counter(g for x in self.templates for g in x[2])
        for k, (_, _, grams, m, low, _) in enumerate(self.templates):
            have = 0
            for g in sorted(grams, key=lambda g: (spread[g], -len(g[0]) - len(g[1]), g)):
                self.owners.setdefault(g, []).append(k)
                have += grams[g]
                if have > m - low:
                    break
        self.marks = re.compile("|".join(sorted({re.escape(max(g, key=len)) for g in self.owners}, key=len, reverse=True)) or r"(?!)")

    def windows(self, grams: list[tuple[str, str]], k: int, around: list[int]):
        """(dice, start, end): of every start near the marked places, the best window within the size bounds, if it reaches the threshold."""
        _, _, want, m, low, high = self.templates[k]
        done = 0
        for first, last in _spans(around, high):
            a = max(done, first)
            yield from (self._best_long if m > LONG else self._best_short)(grams, k, a, last + 1)
            done = last + 1

    def best_from(self, grams: list[tuple[str, str]], k: int, a: int, stop: int):
        """(dice, end) of the best window that starts at a and ends by ``stop``, the shortest of equal ones."""
        _, _, want, m, low, high = self.templates[k]
        have: dict[tuple[str, str], int] = {}
        shared, best = 0, (0.0, 0)
        for b in range(a, min(stop, a + high)):
            g = grams[b]
            if g in want:
                have[g] = have.get(g, 0) + 1
                shared += have[g] <= want[g]
            n = b - a + 1
            if n >= low and (dice := 2 * shared / (m + n)) > best[0]:
                best = (dice, b + 1)
        return best if best[0] >= self.t else None

    def _best_short(self, grams, k, start, stop):
        for a in range(start, stop):
            if found := self.best_from(grams, k, a, len(grams)):
                yield found[0], a, found[1]

    def _best_long(self, grams, k, start, stop):
        """The same for long templates: the counts of shared bigrams up to every end are kept, and a start that is passed lowers a span of them."""
        import numpy as np

        _, _, want, m, low, high = self.templates[k]
        end = min(len(grams), stop - 1 + high)
        have: dict[tuple[str, str], int] = {}
        spots: dict[tuple[str, str], list[int]] = {}
        shared = np.zeros(end - start, np.int64)
        for b in range(start, end):
            g = grams[b]
            if g in want:
                spots.setdefault(g, []).append(b)
                have[g] = have.get(g, 0) + 1
                shared[b - start] = have[g] <= want[g]
        shared = np.cumsum(shared)
        passed = dict.fromkeys(spots, 0)
        sizes = m + np.arange(1, high + 1)
        for a in range(start, stop):
            ends = shared[a - start + low - 1 : a - start + high]
            if len(ends):
                # shares are compared as they are elsewhere, as quotients of the same integers
                dice = 2 * ends / sizes[low - 1 : low - 1 + len(ends)]
                i = int(dice.argmax())
                if dice[i] >= self.t:
                    yield float(dice[i]), a, a + low + i
            g = grams[a]
            if g in want:
                # without this one, the next occurrence past the template's own number counts from its place on
                at, passed[g] = passed[g] + want[g], passed[g] + 1
                over = spots[g][at] if at < len(spots[g]) else end
                shared[a - start : over - start] -= 1

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """(license, notice, dice, first word, words) of every occurrence: windows that overlap no better one."""
        import heapq

        if not self.marks.search((text or "").lower()):
            return []
        ws = words(text)
        grams = bigrams(ws)
        near: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            for k in self.owners.get(g, ()):
                near.setdefault(k, []).append(i)
        hits = []
        for k, around in near.items():
            name, number = self.templates[k][:2]
            hits += ((-dice, first, name, number, last + 1, k) for dice, first, last in self.windows(grams, k, around))
        # of windows that overlap, the one with the highest coefficient stays; what it leaves free may hold others
        heapq.heapify(hits)
        taken: list[tuple] = []
        free = bytearray(b"\1" * len(ws))
        while hits:
            dice, first, name, number, last, k = heapq.heappop(hits)
            stop = free.find(0, first, last)
            if stop < 0:
                free[first:last] = bytes(last - first)
                taken.append((name, number, -dice, first, last - first))
            elif stop - 1 - first >= self.templates[k][4] and (found := self.best_from(grams, k, first, stop - 1)):
                # a start whose best window is taken in part may have a shorter one before that
                heapq.heappush(hits, (-found[0], first, name, number, found[1] + 1, k))
        return sorted(taken)


#: Bigrams of a template from which on its windows are counted by spans.
LONG = 64


def _spans(around: list[int], high: int):
    """(first, last) starts of windows of up to ``high`` that hold one of the sorted places."""
    first = last = None
    for at in around:
        low = max(0, at - high + 1)
        if first is None:
            first = low
        elif low > last + 1:
            yield first, last
            first = low
        last = at
    if first is not None:
        yield first, last


def scan(df: DataFrame, doc_id: str, text: str, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, notice, dice, first_word, n_words): the licences found anywhere in each whole text.

    One row for each occurrence of a notice at ``threshold`` or above in a row of ``df``; of overlapping ones
    the best, of equal ones the first, then the first by name and number.  Texts without any, null and empty
    ones give no row.  Repeated rows come out repeated, a null doc_id stays null, other columns are not read.
    """
    import pandas as pd

    given = templates or TEMPLATES

    def run(batches):
        s = Scanner(given, threshold)
        for pdf in batches:
            out = [(doc, *x) for doc, t in zip(pdf["doc_id"], pdf["text"]) for x in s.scan(t)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "notice", "dice", "first_word", "n_words"]).astype({"doc_id": "Int64"})

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return rows.mapInPandas(run, "doc_id long, license string, notice int, dice double, first_word int, n_words int")


def op3_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")
