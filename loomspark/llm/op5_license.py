"""License scans by patience alignment.

A template and a region of a text are aligned as word sequences: words that are unique in both are anchors, their longest
increasing subsequence is kept, and the gaps between anchors are aligned the same way, recursively; equal words at a gap's
ends are taken first. Coverage is the share of the template's words that are aligned.

Which regions are tried follows from the threshold, so that none is missed: a template that is covered to at least
`coverage` leaves out at most (1 - coverage) of its words, so a text that holds none of a larger set of its words (the
template's triggers, the words least usual in prose) can't reach it. Regions are the stretches around triggers.

One-line templates differ in a word or two. In those of fewer than `SHORT` words every name, variant or version word must be
aligned, and the aligned stretch of the text may hold no other such word. Aligned words must also be dense in the text: they
are `density` of the stretch from the first to the last at least, so that words scattered over prose are no notice; those of
one-line templates stand next to each other but for SHORT_GAP words.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, load

COVERAGE, DENSITY = 0.8, 0.6
#: Other words that may stand between those of a one-line template.
SHORT_GAP = 1
WORD = re.compile(r"[^\W_]+")
#: License texts and notices that are looked for. Public standard wordings.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "gpl-2.0-line": "Licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-line": "GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-line": "GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "GNU Affero General Public License, version 3.",
    "mpl-2.0-line": "Mozilla Public License, version 2.0.",
    "bsd-notice": "Released under the BSD License.",
    "isc-notice": "Released under the ISC License.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc-by-4.0-notice": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc-by-sa-4.0-notice": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc-by-nc-4.0-notice": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    ),
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal Public Domain Dedication.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}
#: Templates of fewer words need their names, variants and versions; other ones of these (but "by") within the stretch refute them.
SHORT = 20
_TELLING = set("mit apache bsd isc mozilla gnu lesser library affero cc cc0 by nc nd sa attribution sharealike noncommercial noderivatives boost".split())
#: Names that tell longer templates apart.
_NAMES = set("lesser affero mozilla boost sharealike noncommercial noderivatives sa nc nd".split())
#: Words too usual to be triggers.
_USUAL = set("a an the of and or in on to is it be by as at for with this that are was any all not you no but may must from under use above".split())


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words in order, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a = {w for w, n in Counter(a[i:j]).items() if n == 1}
        once_b = {w for w, n in Counter(b[k:m]).items() if n == 1}
        where = {b[y]: y for y in range(k, m) if b[y] in once_b}
        shared = [(x, where[a[x]]) for x in range(i, j) if a[x] in once_a and a[x] in where]
        # Longest increasing subsequence of places in b, by piles.
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(shared):
            p = bisect.bisect_left(tops, y)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(y)
                piles.append(n)
            else:
                tops[p], piles[p] = y, n
        if not piles:
            continue
        chain, n = [], piles[-1]
        while n >= 0:
            chain.append(shared[n])
            n = back[n]
        chain.reverse()
        out += chain
        x0, y0 = i, k
        for x, y in [*chain, (j, m)]:
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
    return sorted(out)


def telling(word: str) -> bool:
    return word in _TELLING or word.isdigit()


class Template:
    def __init__(self, name: str, text: str, coverage: float, density: float = DENSITY):
        self.name, self.words, self.coverage, self.density = name, words(text), coverage, density
        self.most_missing = int(len(self.words) * (1 - coverage) + 1e-9)
        self.telling = {i for i, w in enumerate(self.words) if telling(w) and w != "gnu"} if len(self.words) < SHORT else None
        #: For longer ones, the names that tell variants apart.
        self.named = {w for w in _NAMES if w in self.words}
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.counts = count = Counter(self.words)
        self.triggers: set[str] = set()
        held = 0
        for w in sorted(count, key=lambda w: (w in _USUAL, -len(w), w)):
            if held > self.most_missing:
                break
            self.triggers.add(w)
            held += count[w]

    def fits(self, pairs: list[tuple[int, int]], text: list[str]) -> bool:
        """Whether the aligned words are dense in the text and tell this template from its variants.

        Of a one-line template the telling words, and no others, stand in the aligned stretch; the General Public License is
        known without "gnu". Of a longer one no other license's name stands there, and one of its own does.
        """
        first, last = pairs[0][1], pairs[-1][1] + 1
        if self.telling is None:
            names = {w for w in text[first:last] if w in _NAMES}
            return len(pairs) >= self.density * (last - first) and names <= self.named and bool(names) == bool(self.named)
        here = {y for _, y in pairs}
        gaps = sum(text[y] != "gnu" for y in range(first, last) if y not in here)
        return gaps <= SHORT_GAP and self.telling <= {x for x, _ in pairs} and not any(text[y] != "by" and telling(text[y]) and y not in here for y in range(first, last))

    def best(self, text: list[str], hits: list[int]) -> tuple[float, int, int] | None:
        """coverage, first and last + 1 word of the best region around the triggers' places (in order), if it reaches the threshold; the first of equals.

        Each trigger's place begins a window, of which its region's length bounds the number, so the work is linear in the text.
        """
        n = len(self.words)
        found = None
        reach = 2 * n
        regions: list[list[int]] = []
        for h in hits:
            a, b = max(0, h - reach), min(len(text), h + reach + 1)
            if regions and a <= regions[-1][1] and b - regions[-1][0] <= 3 * reach:
                regions[-1][1] = b
            else:
                regions.append([a, b])
        for a, b in regions:
            region = text[a:b]
            own = hits[bisect.bisect_left(hits, a) : bisect.bisect_left(hits, b)]
            # Repeated notices in a region hide unique words: windows that begin at each place of a trigger are tried too.
            spans = [(0, len(region))] + [(max(0, h - a - n), min(len(region), h - a + n)) for h in own]
            # A one-line template's neighbouring notices, and a template that fills its window, are told apart by place.
            spans += [(max(0, h - a - k), min(len(region), h - a - k + n + (SHORT_GAP if self.telling is not None else 0))) for h in own for k in self.places[text[h]]]
            for s, e in dict.fromkeys(spans):
                have = Counter(region[s:e])
                if sum(min(k, have[w]) for w, k in self.counts.items()) < self.coverage * n:
                    continue  # too few of the template's words, in whatever order
                pairs = align(self.words, region[s:e])
                if len(pairs) >= self.coverage * n and self.fits(pairs, region[s:e]) and (found is None or len(pairs) / n > found[0]):
                    found = len(pairs) / n, a + s + pairs[0][1], a + s + pairs[-1][1] + 1
                    if found[0] == 1:
                        return found
        return found


def scan(text: str, templates: list[Template], triggers: dict[str, list[int]]) -> list[tuple[str, float, int, int]]:
    """name, coverage, first word, last word + 1 of every template that a text covers."""
    low = words(text)
    if triggers.keys().isdisjoint(low):
        return []
    hits: dict[int, list[int]] = {}
    for i, w in enumerate(low):
        if w in triggers:
            for t in triggers[w]:
                hits.setdefault(t, []).append(i)
    out = []
    for t in sorted(hits):
        if (best := templates[t].best(low, hits[t])) is not None:
            out.append((templates[t].name, *best))
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order of name), best_coverage, matches (array of name, coverage, start, end in words); one row per input row.

    Null and empty texts match nothing (best_coverage 0). Several notices of one template in a text count once, at the best
    covered place, the first of equals. Whole texts are scanned, in time linear in their length. Rows that repeat are each
    scanned; other columns aren't read; an empty table gives no rows.
    """
    source = dict(templates or TEMPLATES)

    def run(batches):
        made = [Template(k, v, coverage, density) for k, v in sorted(source.items())]
        triggers: dict[str, list[int]] = {}
        for i, t in enumerate(made):
            for w in t.triggers:
                triggers.setdefault(w, []).append(i)
        for b in chunks(batches):
            found = [scan(t or "", made, triggers) for t in b.column("text").to_pylist()]
            matches = pa.array([[{"name": n, "coverage": c, "start": s, "end": e} for n, c, s, e in x] for x in found], pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), matches], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, matches array<struct<name:string,coverage:double,start:bigint,end:bigint>>")
    return out.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.transform("matches", lambda m: m["name"]).alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"), "matches")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
