"""License scans: Dice coefficient over word bigrams against licence templates.

A text's units are its lines (0), every block of lines between blank ones (1), runs of
adjacent blocks (2) and the sentences of a line that has several (3), so that a notice inside
a line, a notice of one line and a licence of many paragraphs are all seen.  Comment marks
aren't words; a line of nothing else is blank.  Unit and template are normalised to lower-case
words; with A and B their sets of word bigrams (a unit of one word has that word as its only
bigram), the score is 2 |A n B| / (|A| + |B|).  A score of t needs the smaller set to have at
least t / (2 - t) of the larger one's size, which prunes most (unit, template) pairs before
any bigram is compared; a run has at most as many words as (2 - t) / t times the longest
template.  Of blocks and runs that overlap, a run counts if no other has a greater score
(of equal ones the first, then the shortest counts).

Cases: null and empty texts, blank lines and units without words have no match; rows
without an id are scanned (id null); of several templates the best score counts, ties go to
the first name; each row is scanned alone, so repeated rows give repeated results; a very
long text is scanned whole; an empty table gives no rows; other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

LIMIT = 0.75
SCHEMA = "doc_id long, unit int, first_line int, n_lines int, license string, dice double, n_words int"

TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License.",
    "All rights reserved": "All rights reserved.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD notice": "Distributed under the BSD License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "Released into the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary notice": "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
}


def bigrams(h: np.ndarray, owner: np.ndarray, n: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bigram), distinct and sorted by owner, of words in reading order; of owners with any known bigram, if these are given."""
    at = np.flatnonzero(owner[1:] == owner[:-1])
    pair = W.mix(W.mix(h[at]) + h[at + 1])
    count = np.bincount(owner, minlength=n)
    single = np.flatnonzero(count[owner] == 1)
    who, what = np.concatenate([owner[at], owner[single]]), np.concatenate([pair, W.mix(h[single] + np.uint64(1))])
    if known is not None:
        some = np.zeros(n, bool)
        if len(known):
            some[who[known[np.minimum(np.searchsorted(known, what), len(known) - 1)] == what]] = True
        who, what = who[some[who]], what[some[who]]
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    if len(who):
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])])
        who, what = who[new], what[new]
    return who, what


class Templates:
    """Bigram sets of all templates: for each bigram of any template the templates that hold it."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        w = W.tokenize(pa.array([templates[k] for k in self.names], pa.string()))
        who, what = bigrams(w.hash, w.doc, len(self.names))
        self.size = np.bincount(who, minlength=len(self.names))
        self.bigrams = np.unique(what)
        self.has = np.zeros((len(self.bigrams), len(self.names)), np.float32)
        self.has[np.searchsorted(self.bigrams, what), who] = 1
        self.words = int(w.counts().max(initial=0))

    def best(self, who: np.ndarray, what: np.ndarray, n: int, limit: float):
        """(unit, template, score) of each unit that reaches the limit."""
        size = np.bincount(who, minlength=n)
        ratio = limit / (2 - limit)
        low, high = ratio * self.size, self.size / ratio
        # sizes that fit no template, and units with too few known bigrams, are out before any comparison
        fits = np.zeros(int(size.max(initial=0)) + 1, bool)
        for a, b in zip(low, high):
            fits[int(np.ceil(a - 1e-9)) : int(np.floor(b + 1e-9)) + 1] = True
        fits[0] = False
        open_ = fits[size]
        rows = np.flatnonzero(open_[who])
        if not len(rows) or not len(self.bigrams):
            return
        at = np.minimum(np.searchsorted(self.bigrams, what[rows]), len(self.bigrams) - 1)
        hit = self.bigrams[at] == what[rows]
        rows, at = rows[hit], at[hit]
        known = np.bincount(who[rows], minlength=n)
        need = np.maximum(1, np.ceil(limit * (size + self.size.min(initial=1)) / 2 - 1e-9))
        good = known[who[rows]] >= need[who[rows]]
        rows, at = rows[good], at[good]
        if not len(rows):
            return
        units, first = np.unique(who[rows], return_index=True)
        both = np.add.reduceat(self.has[at], first, axis=0)
        dice = 2 * both / (size[units][:, None] + self.size)
        top = dice.argmax(axis=1)
        score = dice[np.arange(len(units)), top]
        for k in np.flatnonzero(score >= limit - 1e-9):
            yield int(units[k]), int(top[k]), float(score[k])


def _sentences(w: W.Words) -> np.ndarray:
    """Number of sentence ends (a stop, an exclamation or question mark and a space) before each word."""
    stop = np.isin(w.data, np.frombuffer(b".!?", np.uint8))
    space = np.isin(w.data, np.frombuffer(b" \t\r", np.uint8))
    return np.concatenate([[0], np.cumsum(stop & np.append(space[1:], False))])[w.start]


def _runs(w: W.Words, block: np.ndarray, known: Templates, limit: float):
    """(first block, blocks) of the runs of adjacent blocks that have few enough words and, by counts alone, may reach the limit; single ones first."""
    n = int(block[-1]) + 1
    first = np.searchsorted(block, np.arange(n + 1))
    doc, words = w.doc[first[:-1]], np.diff(first)
    who, what = bigrams(w.hash, block, n)
    size = np.bincount(who, minlength=n)
    hit = np.zeros(len(what), bool)
    if len(known.bigrams):
        hit = known.bigrams[np.minimum(np.searchsorted(known.bigrams, what), len(known.bigrams) - 1)] == what
    mine = np.concatenate([[0], np.cumsum(np.bincount(who[hit], minlength=n))])
    most, least = int(known.words * (2 - limit) / limit), known.size.min(initial=1)
    start, large, length = np.arange(n), size.copy(), 1
    while len(start):
        fits = mine[start + length] - mine[start] + length - 1 >= limit * (large[start] + least) / 2 - 1e-9
        yield start[fits], length
        length += 1
        start = start[start + length <= n]
        start = start[(doc[start] == doc[start + length - 1]) & (first[start + length] - first[start] <= most)]
        large[start] = np.maximum(large[start], size[start + length - 1])


def _outermost(found: list[tuple]) -> list[tuple]:
    """Of (document, first block, blocks, score, ...) those that no overlapping one of the document beats."""
    rank = sorted(found, key=lambda f: (-f[3], f[1], f[2]))
    by: dict[int, list] = {}
    for f in rank:
        by.setdefault(f[0], []).append(f)
    return [f for fs in by.values() for k, f in enumerate(fs) if not any(g[1] < f[1] + f[2] and f[1] < g[1] + g[2] for g in fs[:k])]


def scan_texts(texts: pa.Array, known: Templates, limit: float):
    """(document, unit kind, first line, lines, template, score, words) of each match; kind 0: a line, 1: a block of lines, 2: a run of blocks, 3: a sentence of a line."""
    texts = W.fill(texts)
    w = W.tokenize(texts)
    if not len(w.hash):
        return
    line = np.cumsum(w.data == 10)  # new lines up to each byte
    at_start = np.concatenate([[0], line])[w.offsets[:-1]]
    word_line = line[w.start] - at_start[w.doc]
    # a block ends at a line without words
    edge = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
    new_line = edge | np.concatenate([[True], word_line[1:] != word_line[:-1]])
    new_block = edge | np.concatenate([[True], word_line[1:] > word_line[:-1] + 1])
    ends = _sentences(w)
    new_sentence = new_line | np.concatenate([[True], ends[1:] != ends[:-1]])
    for kind, new in ((0, new_line), (1, new_block), (3, new_sentence)):
        owner = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(owner))
        who, what = bigrams(w.hash, owner, len(first), known.bigrams)
        for u, t, score in known.best(who, what, len(first), limit):
            a, b = first[u], end[u] - 1
            lines = int(word_line[b] - word_line[a] + 1)
            part = not (new_line[a] and (b + 1 == len(owner) or new_line[b + 1]))
            if kind == 0 or (kind == 1 and lines > 1) or (kind == 3 and part):
                yield int(w.doc[a]), kind, int(word_line[a]), lines, t, score, int(b - a + 1)
    block = np.cumsum(new_block) - 1
    first = np.searchsorted(block, np.arange(int(block[-1]) + 2))
    found = []
    for start, length in _runs(w, block, known, limit):
        if not len(start):
            continue
        size = first[start + length] - first[start]
        at = np.repeat(first[start] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        who, what = bigrams(w.hash[at], np.repeat(np.arange(len(start)), size), len(start), known.bigrams)
        found += [(int(w.doc[first[start[u]]]), int(start[u]), length, score, t) for u, t, score in known.best(who, what, len(start), limit)]
    for d, k, length, score, t in _outermost(found):
        if length > 1:
            a, b = first[k], first[k + length] - 1
            yield d, 2, int(word_line[a]), int(word_line[b] - word_line[a] + 1), t, score, int(b - a + 1)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, unit, first_line, n_lines, license, dice, n_words) of each unit that reaches the limit; unit 0: a line, 1: a block, 2: a run of blocks, 3: a sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches):
        known = shared.value
        for part in W.slices(batches):
            ids = part.column("doc_id")
            rows = [(ids[d].as_py(), k, a, n, known.names[t], s, m) for d, k, a, n, t, s, m in scan_texts(part.column("text"), known, limit)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "unit", "first_line", "n_lines", "license", "dice", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
