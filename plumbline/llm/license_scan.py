"""License scans: exact containment search of license templates in text blocks.

A template is a set of words; a block is a window of consecutive words of a text, twice as long as the template and
starting at every multiple of the template's length, so that every stretch as long as the template lies whole in some
block.  A block matches when it holds at least ``threshold`` of the template's distinct words.

The search is a set-similarity join.  Words are ordered by how many documents of the whole corpus hold them, rarest
first.  A matching block must hold one of a template's first ``size - needed + 1`` words in that order (prefix filter),
at least ``needed`` words of the templates' vocabulary (length filter), and, from the position of the first common word
in both ordered sets on, enough words to reach ``needed`` (position filter).  Blocks without a prefix word are never
built.  Templates are parameters, so their index is broadcast; the corpus is scanned where it lies, without a shuffle
but for the counts of the template words.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases (as consecutive words) and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence bodies, notices and lines by label; only their words count.
TEMPLATES = {
    "mit-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-2.0-body": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-body": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Bytes that are no part of a word become blanks; A-Z become a-z.
WORD_TABLE = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The lower-cased words: runs of digits, letters a-z and everything outside ASCII."""
    return (text or "").encode().translate(WORD_TABLE).split()


class Index:
    """Templates over a global order of words; ``order`` maps each template word to its rank, rarest first."""

    def __init__(self, templates: dict[str, str], threshold: float, order: dict[bytes, int]):
        self.order, self.labels = order, sorted(templates)
        self.sets = [sorted({order[w] for w in words(templates[label])}) for label in self.labels]
        self.spans = [max(1, len(words(templates[label]))) for label in self.labels]
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefix: dict[int, list[int]] = defaultdict(list)
        for t, ranks in enumerate(self.sets):
            for rank in ranks[: len(ranks) - self.needed[t] + 1]:
                self.prefix[rank].append(t)
        self.rare = frozenset(w for w, r in order.items() if r in self.prefix)

    def matches(self, found: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, containment) of every matching block."""
        if self.rare.isdisjoint(found):
            return []
        order = self.order
        places = [(i, order[w]) for i, w in enumerate(found) if w in order]
        starts = [i for i, _ in places]
        blocks: set[tuple[int, int]] = set()
        for i, rank in places:
            for t in self.prefix.get(rank, ()):
                k = i // self.spans[t]
                blocks.update(((t, k), (t, k - 1)) if k else ((t, k),))
        out = []
        for t, k in sorted(blocks):
            span, needed, template = self.spans[t], self.needed[t], self.sets[t]
            lo, hi = bisect_left(starts, k * span), bisect_left(starts, (k + 2) * span)
            block = sorted({rank for _, rank in places[lo:hi]})
            if len(block) < needed:
                continue
            i = j = overlap = 0
            while i < len(block) and j < len(template) and overlap + min(len(block) - i, len(template) - j) >= needed:
                a, b = block[i], template[j]
                overlap += a == b
                i, j = i + (a <= b), j + (b <= a)
            if overlap >= needed:
                out.append((self.labels[t], k * span, min((k + 2) * span, len(found)), overlap / len(template)))
        return out


def phrase_places(found: list[bytes], phrases: list[list[bytes]]) -> list[tuple[int, int]]:
    """(phrase, first word) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(found) + b" "
    out = []
    for p, phrase in enumerate(phrases):
        if b" " + b" ".join(phrase) + b" " in joined:
            out += [(p, i) for i in range(len(found) - len(phrase) + 1) if found[i] == phrase[0] and found[i : i + len(phrase)] == phrase]
    return out


def word_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the (bounded) vocabulary."""

    def run(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """One row per document: word count, places of the phrases, labels, and the matching blocks.

    Columns: doc_id, n_words, n_base, first_word, last_word (null without a place), base_labels, labels (distinct, sorted,
    comma-joined), score (1 for a phrase, else the largest containment found, else 0), blocks (array of label, first_word,
    end_word, containment).

    A null text is an empty one: no words, no labels, score 0.  Repeated rows and null ids are documents like any other,
    an empty table gives an empty result, and further columns are ignored.
    """
    phrases, templates = phrases if phrases is not None else PHRASES, templates if templates is not None else TEMPLATES
    common.small_batches(docs.sparkSession)
    vocabulary = frozenset(w for t in templates.values() for w in words(t))
    counts = word_counts(docs, text_col, vocabulary) if vocabulary else {}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = Index({k: v for k, v in templates.items() if words(v)}, threshold, order)
    wanted, names = [words(p) for p in phrases], list(phrases.values())
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    block = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = words(text)
                places = phrase_places(found, wanted)
                blocks = index.matches(found)
                base = {names[p] for p, _ in places}
                at = [i for _, i in places]
                score = 1.0 if places else max((b[3] for b in blocks), default=0.0)
                rows.append((len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b[0] for b in blocks})), score, [dict(zip(("label", "first_word", "end_word", "containment"), b, strict=True)) for b in blocks]))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:long,end_word:long,containment:double>>"
    return narrow.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents")).drop("blocks")
