"""Licence scans by conditional compression.

A candidate block is a stretch of words that holds enough of some template's words to be
its wording, whatever their order; no stretch that wording could confirm is left out.
Each block is compressed bare and with every template that it can hold as a raw
zstandard dictionary, and the bytes that a dictionary saves rank the templates.  They are confirmed in
that order by wording: the exact differences, word by word, between the template and
the part of the block that it aligns with.  The first that is confirmed takes its
places; its words are taken out of the block, and what is left is ranked anew, until
nothing is confirmed.  A rank decides who is first and drops nobody: a template whose
wording stands in what the better ones left is always found.  Decisive words, which
are names, versions and negations, must be the same: a block that loses, changes or
adds one is another licence, or none.

Defined results: null and empty texts give no rows, nor does an empty set of templates.  Names,
years and other fill-ins (``<...>`` in a template) match any few words.  Repeated
rows are scanned alike.  Texts are whole: every word of a text that can hold a template is looked at,
in blocks of bounded length that overlap by the widest template.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wordings of common public licences and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <url> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is licensed under the GNU Lesser General Public License, version <version>.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <n> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <n> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <n> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <n> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <n> Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "proprietary": "All rights reserved.",
}
#: Words that decide which licence it is, or turn its sense around: none may be lost, changed or put in.
DECISIVE = frozenset(
    "not never cannot except excluding without mit apache gnu gpl lesser library affero mozilla creative commons cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd attribution noncommercial noderivatives noderivs "
    "sharealike bsd isc unencumbered reserved waived proprietary".split()
)
RESULT = "array<struct<start: long, end: long, license: string, reduction: double, coverage: double, differences: string>>"
#: Words that turn the sense of a wording that they stand shortly before.
_TURNS = frozenset(("not", "never", "cannot", "isn", "aren", "wasn"))
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_WORDING = re.compile(rf"<[^>]*>|{_WORD.pattern}")


def _words(text: str, pattern: re.Pattern = _WORD) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in pattern.finditer(text)]


def decides(word: str) -> bool:
    """Whether a word of a wording may not differ: a name, a negation, a version, or a compound of such."""
    return any(c.isdigit() for c in word) or word in DECISIVE or any(part in DECISIVE for part in word.split("-"))


def gate(templates: dict[str, str], least: float) -> str:
    """A regular expression that every text in which a template can be confirmed matches.

    A decisive word stands in every such text.  Of a wording without one, so many of its
    words may be lost; of one word more than that, one at least stands there.
    """
    wanted: set[str] = set()
    for wording in templates.values():
        own = [w for w, _, _ in _words(wording, _WORDING) if not w.startswith("<")]
        sure = [w for w in own if decides(w)]
        if sure:
            wanted.add(max(sure, key=lambda w: (not any(c.isdigit() for c in w), len(w), w)))
        elif own:
            wanted.update(sorted(own, key=lambda w: (-len(w), w))[: int((1 - least) * len(own)) + 1])
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in sorted(wanted)) + r")(?![\p{L}\p{N}])" if wanted else r"(?!)"


def templates_of(table: DataFrame, most: int = 10_000) -> dict[str, str]:
    """Templates from a table (license, wording); a table of more than ``most`` rows fails."""
    rows = table.select("license", "wording").where("license is not null and wording is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return {r["license"]: r["wording"] for r in rows}


class Template:
    """A wording: its words, how many of each, the widest stretch that it fills, and its dictionary."""

    def __init__(self, name: str, wording: str) -> None:
        self.name = name
        self.want = [w for w, _, _ in _words(wording, _WORDING)]
        self.counts = Counter(w for w in self.want if not w.startswith("<"))
        self.fixed = self.counts.total()
        self.fills = len(self.want) - self.fixed
        self.width = len(self.want) + 4 + 8 * min(self.fills, 4)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(self._packed() or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def _packed(self) -> bytes:
        return " ".join(w for w in self.want if not w.startswith("<")).encode("utf-8", "surrogatepass")


#: Stands for a word that a find has taken; no wording holds it.
TAKEN = "\0"


class Scanner:
    """Templates with their dictionaries, made once in a task."""

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.bare = zstandard.ZstdCompressor(level=3)
        self.known = [Template(name, wording) for name, wording in templates.items()]
        self.widest = max((t.width for t in self.known), default=0)

    def scan(self, text: str) -> list[tuple]:
        own = _words(text)
        rows = []
        for lo, hi, last, able in self._blocks(own):
            rows += self._settled(own, lo, hi, last, able)
        return sorted(rows)

    def _blocks(self, own: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int, list[Template]]]:
        """(first word, end, where the next block begins, templates that can stand in it) of the candidate blocks, from left to right.

        Finds that begin where the next block does belong to that one, which holds them whole.
        """
        at = defaultdict(list)
        for i, (w, _, _) in enumerate(own):
            at[w].append(i)
        stretches = []
        for template in self.known:
            if sum(min(n, len(at.get(w, ()))) for w, n in template.counts.items()) >= self.least * template.fixed:
                places = sorted(i for w in template.counts for i in at.get(w, ()))
                stretches += [(a, z, template) for a, z in self._able(own, places, template)]
        stretches.sort(key=lambda x: x[:2])
        starts, size, k = [a for a, _, _ in stretches], 4 * self.widest, 0
        while k < len(stretches):
            lo, hi = stretches[k][:2]
            while k < len(stretches) and stretches[k][0] <= hi:
                hi = max(hi, stretches[k][1])
                k += 1
            hi = min(hi, len(own))
            # a long run of stretches goes in blocks that overlap by the widest template
            while lo < hi:
                end = min(lo + size, hi)
                last = end if end == hi else end - self.widest
                # no stretch is longer than twice the widest template
                near = stretches[bisect_left(starts, lo - 2 * self.widest) : bisect_left(starts, end)]
                yield lo, end, last, list({t.name: t for _, z, t in near if z > lo}.values())
                lo = last

    def _able(self, own: list[tuple[str, int, int]], places: list[int], template: Template) -> Iterator[tuple[int, int]]:
        """Merged stretches from a word of the template on, as wide as it can be, that share enough words with it in any order."""
        held: Counter = Counter()
        common, upto, open_ = 0, 0, None
        for i, place in enumerate(places):
            while upto < len(places) and places[upto] < place + template.width:
                w = own[places[upto]][0]
                held[w] += 1
                common += held[w] <= template.counts[w]
                upto += 1
            if common >= self.least * template.fixed:
                # a few words more, as others are looked at from the parts of an alignment on
                end = place + 2 * template.width
                if open_ and place <= open_[1] and end - open_[0] <= 2 * self.widest:
                    open_[1] = end
                else:
                    if open_:
                        yield open_[0], open_[1]
                    open_ = [place, end]
            w = own[place][0]
            common -= held[w] <= template.counts[w]
            held[w] -= 1
        if open_:
            yield open_[0], open_[1]

    def ranked(self, words: list[str], able: list[Template]) -> list[tuple[int, float, Template]]:
        """(bytes saved, share of the bare size, template), most bytes first."""
        data = " ".join(w for w in words if w != TAKEN).encode("utf-8", "surrogatepass")
        bare = len(self.bare.compress(data))
        saved = [(bare - len(t.packer.compress(data)), t) for t in able]
        return [(n, n / bare, t) for n, t in sorted(saved, key=lambda x: (-x[0], x[1].name))]

    def _settled(self, own: list[tuple[str, int, int]], lo: int, hi: int, last: int, able: list[Template]) -> Iterator[tuple]:
        """The finds of a block that begin before last; their words are taken out of own."""
        while able:
            words = [own[i][0] for i in range(lo, hi)]
            for _, share, template in self.ranked(words, able):
                # what is not confirmed now will not be when there are fewer words
                able = [t for t in able if t is not template]
                places = [i for i in range(lo, hi) if own[i][0] in template.counts]
                got = sorted(g for g in self._places(own, places, template) if g[0] < last)
                for a, z, coverage, differences in got:
                    yield own[a][1], own[z - 1][2], template.name, round(share, 6), coverage, differences
                for a, z, _, _ in got:
                    own[a:z] = [(TAKEN, *own[i][1:]) for i in range(a, z)]
                if got:
                    break
            else:
                return

    def _places(self, own: list[tuple[str, int, int]], places: list[int], template: Template) -> Iterator[tuple[int, int, float, str]]:
        """(first word, end, coverage, differences) of all stretches of own where the wording stands; places are those of its words.

        A stretch begins at a word of the template, and the words that it shares with the
        template in any order bound what it can align: the others are not aligned.
        """
        todo = [(0, len(places))]
        while todo:
            a, z = todo.pop()
            end = places[z - 1] + 1 if z > a else 0
            held: Counter = Counter()
            common, upto = 0, a
            for i in range(a, z):
                while upto < z and places[upto] < places[i] + template.width:
                    w = own[places[upto]][0]
                    held[w] += 1
                    common += held[w] <= template.counts[w]
                    upto += 1
                if common >= self.least * template.fixed and (got := self._closest(own, places[i], end, template)):
                    yield got
                    # the same wording may stand before it and after it
                    todo.append((i, bisect_left(places, got[0])))
                    todo.append((bisect_left(places, got[1]), z))
                    break
                w = own[places[i]][0]
                common -= held[w] <= template.counts[w]
                held[w] -= 1

    def _closest(self, own: list[tuple[str, int, int]], at: int, end: int, template: Template) -> tuple | None:
        """The place that covers most in the fewest words, among those that begin where a part aligned at ``at`` does."""
        first, starts = self._confirm(own, at, end, template)
        if first is None:
            return None
        others = (self._confirm(own, s, end, template)[0] for s in starts if s > at)
        return max([first, *(o for o in others if o)], key=lambda g: (g[2], g[0] - g[1], -g[0]))

    def _confirm(self, own: list[tuple[str, int, int]], at: int, end: int, template: Template) -> tuple[tuple | None, list[int]]:
        """(first word, end, coverage, differences) if the wording stands nearly word for word from ``at`` on, and where its parts begin."""
        want = template.want
        words = [w for w, _, _ in own[at : min(end, at + template.width)]]
        parts = [m for m in difflib.SequenceMatcher(None, words, want, autojunk=False).get_matching_blocks() if m.size]
        coverage = sum(m.size for m in parts) / max(template.fixed, 1)
        if not parts or coverage < self.least:
            return None, []
        lo, hi = parts[0].a, parts[-1].a + parts[-1].size
        if any(w in _TURNS for w in [w for w, _, _ in own[max(0, at + lo - 3) : at + lo]]):
            return None, [at + m.a for m in parts]
        differences = []
        for op, a1, a2, b1, b2 in difflib.SequenceMatcher(None, words[lo:hi], want, autojunk=False).get_opcodes():
            if op == "equal":
                continue
            fill = b1 < b2 and all(w.startswith("<") for w in want[b1:b2])
            lost, put_in = [w for w in want[b1:b2] if not w.startswith("<") and decides(w)], [] if fill else [w for w in words[lo:hi][a1:a2] if decides(w)]
            if lost or put_in:
                return None, [at + m.a for m in parts]
            if not fill:
                differences.append(f"-{' '.join(want[b1:b2])}+{' '.join(words[lo:hi][a1:a2])}")
        return (at + lo, at + hi, round(min(coverage, 1.0), 6), "; ".join(differences)), [at + m.a for m in parts]


def scan(docs: DataFrame, into: str, templates: dict[str, str] | None = None, least: float = 0.85) -> DataFrame:
    """docs whose text can hold a template, with one more column: the licences confirmed in it.

    least: share of a template's words that must stand there.
    """
    names = ("start", "end", "license", "reduction", "coverage", "differences")
    wordings = TEMPLATES if templates is None else templates

    @F.pandas_udf(RESULT)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(wordings, least)
        for part in parts:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in scanner.scan(t)] if t else [] for t in part], dtype=object)

    return docs.where(F.col("text").rlike(gate(wordings, least))).withColumn(into, found("text"))


def op1_licenses(docs: DataFrame) -> DataFrame:
    """One row per licence found: doc_id, start and end (code points), license, reduction, coverage, differences."""
    rows = scan(docs.select("doc_id", "text"), "found").select("doc_id", F.explode("found").alias("f"))
    return rows.select("doc_id", "f.start", "f.end", "f.license", "f.reduction", "f.coverage", "f.differences")
