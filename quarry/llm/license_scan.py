"""Licence scans with a generalised suffix automaton.

The automaton holds the words of licence templates (``TEMPLATES``). A document
streams through it word by word: the matching statistics give, at each word,
the longest run ending there that occurs in a template. Runs of at least
``MIN_RUN`` words that cannot be extended are chained in template order with
gaps of at most ``MAX_GAP`` words of any kind (a run that begins inside the run
before it, in the document or in the template, gives up the words that overlap); a
chain covers a span of the document, and the covered share of the template is its
score. Templates are openings and whole notices; spans inside a longer span of the
same label are left out. ``templates_of`` reads more templates from a table. Only stretches of
words that occur in some template are streamed, as no run can hold another word;
the runs of all stretches of a document are chained together.

Defined results: null and empty texts have no words, no labels and score 0; very
long texts are scanned whole; an empty table gives an empty result; repeated rows each get the same result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import NON_ALNUM, hash_one, hash_words, words_of

MIN_RUN, MAX_GAP, COVER = 4, 8, 0.6
#: Words that a table of templates may hold in all: the automaton is built on the driver and broadcast.
TEMPLATE_WORDS = 200_000
#: Phrases that label a document wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed texts of public licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
#: Fixed texts of public licence notices, whole.
WHOLE = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see <https://www.gnu.org/licenses/>."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def template_words(text: str) -> list[str]:
    """The words of a template, cut and lower-cased as those of the documents."""
    return _WORD.findall(text.translate(_LOWER))


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from a table (label, text), in order; rows without a label or a word
    are left out, repeated rows count once. More than ``TEMPLATE_WORDS`` words in all
    are an error."""
    rows = table.select("label", "text").where("label IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 40 * TEMPLATE_WORDS:
        raise ValueError(f"templates of {size} characters; {40 * TEMPLATE_WORDS} at most")
    found = [(r.label, r.text) for r in rows.orderBy("label", "text").collect() if template_words(r.text)]
    if (n := sum(len(template_words(t)) for _, t in found)) > TEMPLATE_WORDS:
        raise ValueError(f"templates of {n} words; {TEMPLATE_WORDS} at most")
    return found


class Automaton:
    """Suffix automaton of several word sequences; each state knows all places of
    every template where its words end."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [{}]
        for t, text in enumerate(texts):
            last = 0
            for i, c in enumerate(text):
                last = self._extend(last, c)
                s = last
                while s > 0:
                    self.places[s].setdefault(t, []).append(i)
                    s = self.link[s]

    def _new(self, length: int, nxt: dict, link: int, places: dict) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.places.append(places)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], {t: list(at) for t, at in self.places[q].items()})
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, {}, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def runs(self, ids: list[int]) -> list[tuple[int, int, dict[int, list[int]]]]:
        """Runs that cannot be extended: (end, length, places of the end by template)."""
        out, s, n = [], 0, 0
        for i, c in enumerate(ids):
            if c not in self.next[s] and n >= MIN_RUN:
                out.append((i, n, self.places[s]))
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                n = 0
        if n >= MIN_RUN:
            out.append((len(ids), n, self.places[s]))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES + WHOLE, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        cut = [template_words(t) for _, t in templates]
        vocab = sorted({w for t in cut for w in t} | {w for p in phrases for w in p.split()})
        number = {w: i for i, w in enumerate(vocab)}
        h = hash_one([w.encode() for w in vocab])
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.sizes = [len(t) for t in cut]
        self.phrases = [(np.array([number[w] for w in p.split()]), label) for p, label in phrases.items()]
        self.automaton = Automaton([[number[w] for w in t] for t in cut])

    def spans(self, runs: list[tuple[int, int, dict[int, list[int]]]]) -> list[tuple[int, int, int, int]]:
        """Chains of a document's runs (end, length, places), in order of their ends:
        (template, first word, end word, words covered)."""
        by: dict[int, list] = {}
        for end, n, places in runs:
            for t, ends in places.items():
                by.setdefault(t, []).extend((end - n, end, at + 1 - n, at + 1) for at in ends)
        return [(t, *chain) for t, parts in by.items() for chain in chains(parts)]

    def scan(self, col) -> list[dict]:
        w = words_of(col, NON_ALNUM, lower=True)
        h = hash_words(w)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ids = np.where(self.keys[at] == h, self.order[at], -1)
        doc = w.doc()
        n = np.diff(w.off)
        rows = [{"n_words": int(x), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []} for x in n]
        for phrase, label in self.phrases:
            k = len(phrase)
            if len(ids) < k:
                continue
            hit = ids[: len(ids) - k + 1] == phrase[0]
            for j in range(1, k):
                hit &= ids[j : len(ids) - k + 1 + j] == phrase[j]
            for p in np.flatnonzero(hit):
                d = doc[p]
                if doc[p + k - 1] == d:
                    r, q = rows[d], int(p - w.off[d])
                    r["n_base"] += 1
                    r["base"].add(label)
                    r["score"] = 1.0
                    r["first_word"] = q if r["first_word"] is None else min(r["first_word"], q)
                    r["last_word"] = q if r["last_word"] is None else max(r["last_word"], q)
        known = ids >= 0
        starts = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])) if len(ids) else []
        ends = np.flatnonzero(known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])) + 1 if len(ids) else []
        # Words outside the vocabulary end a run, not a chain: runs are gathered by document.
        runs: dict[int, list] = {}
        for a, e in zip(starts, ends):
            if e - a >= MIN_RUN:
                first = int(a - w.off[doc[a]])
                runs.setdefault(int(doc[a]), []).extend((first + end, k, places) for end, k, places in self.automaton.runs(ids[a:e].tolist()))
        for d, held in runs.items():
            r = rows[d]
            for t, first, end, covered in self.spans(held):
                share = min(1.0, covered / self.sizes[t])
                r["score"] = max(r["score"], share)
                if share >= COVER:
                    r["labels"].add(self.labels[t])
                    r["spans"].append({"label": self.labels[t], "first": first, "end": end, "covered": share})
            r["spans"] = outer(r["spans"])
        return [r | {"base_labels": ",".join(sorted(r["base"])), "labels": ",".join(sorted(r["base"] | r["labels"]))} for r in rows]


def outer(spans: list[dict]) -> list[dict]:
    """Spans by first word, without those inside another of their label (of equal
    ones, the best covered stays)."""
    out, ends = [], {}
    for s in sorted(spans, key=lambda s: (s["first"], -s["end"], -s["covered"])):
        if s["end"] > ends.get(s["label"], -1):
            ends[s["label"]] = s["end"]
            out.append(s)
    return out


def chains(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end word, words covered) of the best chains of one template's
    runs (first, end, template's first, template's end), which are in order of
    their ends; a run that the template holds several times is there once for each
    place. The best chain up to each run is found from those before it; each run is
    in one chain, without its first words where these repeat the run before."""
    made: list[tuple[int, int]] = []  # words covered up to the run, run before
    for j, (a, e, ta, _) in enumerate(parts):
        best = (e - a, -1)
        for k in range(j - 1, -1, -1):
            if a - parts[k][1] > MAX_GAP:
                break
            trim = max(0, parts[k][3] - ta, parts[k][1] - a)  # words that the run before has, too
            if trim < e - a and a + trim - parts[k][1] <= MAX_GAP:
                best = max(best, (made[k][0] + e - a - trim, k))
        made.append(best)
    out, used = [], set()
    for j in sorted(range(len(parts)), key=lambda j: (-made[j][0], j)):
        k = first = j
        while k >= 0 and parts[k][:2] not in used:
            used.add(parts[k][:2])
            first, k = k, made[k][1]
        if k != j:
            out.append((parts[first][0], parts[j][1], made[j][0] - (made[k][0] if k >= 0 else 0)))
    return sorted(out)


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])))]


def scan_licenses(docs: DataFrame, templates=TEMPLATES + WHOLE, phrases=PHRASES) -> DataFrame:
    """doc_id, the base phrases' counts and places, labels, score and covered spans."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                rows = held.value.scan(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in _FIELDS[1:])], [k for k, _ in _FIELDS])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,covered:double>>"
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(runtime.read(spark, sf_dir, "documents")).drop("spans")
