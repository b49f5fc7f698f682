"""Licence scan by matching statistics on a suffix automaton of template words.

All templates go into one generalised suffix automaton over word numbers.
Streaming a file's words through it gives, for each word, the longest stretch
ending there that occurs in some template.  Stretches that can't be extended and
are long enough are chained where they follow each other in file and template;
a chain that covers enough of a template labels the file.  Templates are sections of
licences, so a part of one is enough, and templates that share their wording are told
apart by the words that only one of them has: of overlapping chains, that which covers
most words of the file stands.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, utf8

# Phrases that label a file wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public licence texts and notices as (label, section, text).  Short licences are
# whole, in sections of their own, so that a file is known by any of them; of long ones these
# are the notices that files carry and the sections that say what is granted.
TEMPLATES = (
    ("mit", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3", "endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib", "conditions", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "grant", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("apache-2", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "notice", "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
)
#: Shortest stretch of words that counts as a match.
SHORTEST = 4
#: Most words left out between two stretches of one chain.
GAP = 6
#: Share of a template's words that a chain must cover.
COVER = 0.6

#: Lower-case letters, digits and all bytes of non-ASCII characters stay; the rest separates words.
_WORDS = bytes(LOWER[b] if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised over several sequences; each state of ``least`` symbols or more knows where, in each sequence, its stretches end."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        places: list[dict[int, set[int]]] = [{}]
        self._places = places
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                places[last].setdefault(number, set()).add(at)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                up = places[self.link[state]]
                for number, found in places[state].items():
                    up.setdefault(number, set()).update(found)
        self.ends: list[dict[int, list[int]]] = [{number: sorted(found) for number, found in p.items()} if n >= least else {} for p, n in zip(places, self.length, strict=True)]
        del self._places

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self._places.append({})
        return len(self.length) - 1

    def _split(self, p: int, symbol: int) -> int:
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, symbol)
        return cur

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """For each symbol the length of, and the state for, the longest match that ends there."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield length, state


@dataclass(frozen=True)
class Scanner:
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    shortest: int = SHORTEST
    gap: int = GAP
    cover: float = COVER
    parts: dict = field(default_factory=dict, compare=False)

    def prepare(self) -> dict:
        if not self.parts:
            texts = [words_of(t.encode()) for *_, t in self.templates]
            vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
            self.parts.update(
                vocabulary=vocabulary,
                sizes=[len(t) for t in texts],
                automaton=SuffixAutomaton([[vocabulary[w] for w in t] for t in texts], self.shortest),
                phrases=[(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in self.phrases],
                run=re.compile(b"\x01{%d,}" % self.shortest),
            )
        return self.parts

    def stretches(self, words: list[bytes]) -> list[tuple[int, int, dict[int, list[int]]]]:
        """Matches that can't be extended: first word, length, and per template all places where they end in it."""
        p = self.prepare()
        vocabulary, automaton = p["vocabulary"], p["automaton"]
        known = bytes([w in vocabulary for w in words])
        out = []
        for m in p["run"].finditer(known):
            a, b = m.span()
            stats = list(automaton.statistics([vocabulary[w] for w in words[a:b]]))
            for i, (length, state) in enumerate(stats):
                if length >= self.shortest and (i + 1 == len(stats) or stats[i + 1][0] <= length):
                    out.append((a + i - length + 1, length, automaton.ends[state]))
        return out

    def chains(self, words: list[bytes]) -> list[tuple[str, str, int, int, float]]:
        """Covered spans of templates: label, section, first word, last word, share covered (at least ``cover``)."""
        p = self.prepare()
        open_chains: dict[int, list[int]] = {}
        done: list[tuple[int, list[int]]] = []
        for first, length, ends in self.stretches(words):
            last = first + length - 1
            for number, places in ends.items():
                chain = open_chains.get(number)
                # [first word, last word, last template word, words covered]
                follows = chain is not None and 0 < last - chain[1] and first - chain[1] - 1 <= self.gap
                # Of the places in the template the next one behind the chain goes on with it.
                at = bisect_right(places, chain[2]) if follows else len(places)
                if at < len(places):
                    end = places[at]
                    chain[3] += min(length, last - chain[1], end - chain[2])
                    chain[1], chain[2] = last, end
                else:
                    if chain:
                        done.append((number, chain))
                    open_chains[number] = [first, last, places[0], length]
        done += open_chains.items()
        found = [(*self.templates[n][:2], c[0], c[1], c[3] / p["sizes"][n], c[3]) for n, c in done if c[3] >= self.cover * p["sizes"][n]]
        # The chain of most words stands; another that lies inside one that stands is part of its wording.
        standing: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[5], -f[4], f[:4])):
            if not any(s[0] != f[0] and s[2] <= f[2] and f[3] <= s[3] for s in standing):
                standing.append(f)
        return sorted(f[:5] for f in standing)

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """First words of the phrases' occurrences, with labels."""
        joined = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.prepare()["phrases"]:
            at, before, counted = joined.find(phrase), 0, 0
            while at >= 0:
                before += joined.count(b" ", counted, at)
                counted = at
                out.append((before, label))
                at = joined.find(phrase, at + 1)
        return sorted(out)


@lru_cache(maxsize=2)
def _prepared(scanner: Scanner) -> Scanner:
    scanner.prepare()
    return scanner


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``.

    ``base_labels`` come from phrases, ``labels`` also from template chains, whose
    spans (label, section, first, last word, covered share) are listed.  ``score`` is 1
    where a phrase occurs and else the largest covered share, 0 without any.
    Null and empty texts have no words, no places and empty label strings.
    """
    scanner = scanner or Scanner()
    templates, phrases, limits = scanner.templates, scanner.phrases, (scanner.shortest, scanner.gap, scanner.cover)
    span = pa.struct([("label", pa.string()), ("section", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])
    schema = pa.schema(
        [("row_id", pa.int64())]
        + [(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]
    )

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _prepared(Scanner(templates, phrases, *limits))

        def rows() -> Iterator[tuple]:
            for b in part:
                for row_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    words = words_of(text)
                    base, chains = scan.places(words), scan.chains(words)
                    labels = {x for _, x in base}
                    both = labels | {c[0] for c in chains}
                    spans = [dict(zip(("label", "section", "first", "last", "covered"), c, strict=True)) for c in chains]
                    score = 1.0 if base else max((c[4] for c in chains), default=0.0)
                    yield row_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(both)), score, spans

        yield from batches(rows(), schema)

    kinds = "row_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,section:string,first:long,last:long,covered:double>>"
    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, kinds)
    return out.withColumnRenamed("row_id", id_col)
