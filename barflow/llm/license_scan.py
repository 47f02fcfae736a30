"""Licence scan with a positional rare-token index.

The templates are notices. Their words are posted in an index with their positions. Of every stretch of STRETCH words of a file, the
TOP licence words of highest IDF are looked up (IDF is counted over all documents; of equal ones the smaller word first); each
occurrence votes, for every posting of its word, that the template begins so many words before it. A template is tried where votes of
enough of its different words agree within its band, among them one of its own rarer half. There its mandatory phrases are verified:
names (a licence's name and version) must stand verbatim, key sentences with at most one edit for each EDIT words (a word put in, left
out, changed, or two neighbours swapped), both about where the votes put them. At last the words of the template that stand there in
order must be SHARE of it. That share is the score of the place; a document's score is its best one.

The base phrases are templates of their own: their rarest word is always looked up, and they count verbatim wherever they stand.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A NULL or empty text has no words, no places, empty labels
and score 0. Long texts are scanned whole; a text without a word of any template's rarer half is done after one look. Of two template
words with the same IDF the earlier one counts as rarer. Places of different templates may overlap; repeated rows give a row each.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import alnum_words, batch, id_type, mapped, narrowed, slices

#: Words of a file that share a look-up, and how many of their licence words are looked up.
STRETCH, TOP = 64, 24
#: Different words of a template that must agree at most; half of a shorter one.
VOTES = 4
#: Words by which votes may differ, at least; an eighth of a longer template.
BAND = 6
#: Words of a key sentence for each edit that it may have.
EDIT = 3
#: Share of a template's words that must stand there in order.
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """Words of a notice; `names` are phrases of it that must stand verbatim, `key` sentences of it that may be edited."""

    label: str
    text: str
    names: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    base: bool = False


#: Phrases of the base labels, then public licence notices with their mandatory phrases.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
    Template("mit", "released under the MIT license", ("mit license",)),
    Template("mit", "MIT License", ("mit license",)),
    Template(
        "mit",
        "The Software is provided AS IS, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular "
        "purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
        "otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
        key=("without warranty of any kind express or implied", "authors or copyright holders be liable", "use or other dealings in the software"),
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
        key=("permission is hereby granted", "person obtaining a copy"),
    ),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", key=("permission is hereby granted", "person obtaining a copy")),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "under the Apache 2.0 license", ("apache 2 0 license",)),
    Template("apache-2.0", "licensed under the Apache Software License, Version 2.0", ("apache software license version 2 0",)),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0",), ("except in compliance with the license",),
    ),
    Template("gpl-3.0", "this work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license", "version 3 of the license"), ("as published by the free software foundation",),
    ),
    Template(
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license", "version 2 of the license"), ("as published by the free software foundation",),
    ),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license",),
    ),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "licensed under CC0 1.0 Universal", ("cc0 1 0",)),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        key=("use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        key=("distribute this software for any purpose", "notice appear in all copies"),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        key=("permission is granted to anyone to use this software", "alter it and redistribute it freely"),
    ),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        key=("free and unencumbered software released into the public domain",),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.",
        key=("nor the names of its contributors may be used", "endorse or promote products derived from this software"),
    ),
    Template(
        "bsd",
        "This software is provided by the copyright holders and contributors AS IS and any express or implied warranties, including, but not limited to, the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed.",
        key=("provided by the copyright holders and contributors as is", "fitness for a particular purpose are disclaimed"),
    ),
    Template(
        "isc",
        "The software is provided AS IS and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event "
        "shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits",
        key=("the author disclaims all warranties with regard to this software", "resulting from loss of use data or profits"),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        key=("any person or organization obtaining a copy", "execute and transmit the software"),
    ),
    Template("wtfpl", "Do What The Fuck You Want To Public License", ("you want to public license",)),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("epl-1.0", "made available under the terms of the Eclipse Public License v1.0", ("eclipse public license v1 0",)),
    Template("cddl-1.0", "subject to the terms of the Common Development and Distribution License", ("common development and distribution license",)),
    Template("artistic-2.0", "licensed under the Artistic License 2.0", ("artistic license 2 0",)),
    *(
        Template(label, f"SPDX License Identifier {name}", (f"spdx license identifier {name}",))
        for label, name in (
            ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0", "gpl 3 0"), ("gpl-3.0-or-later", "gpl 3 0 or later"),
            ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3.0", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("bsd", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc"), ("zlib", "zlib"),
            ("bsl-1.0", "bsl 1 0"), ("unlicense", "unlicense"), ("cc0-1.0", "cc0 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("epl-2.0", "epl 2 0"),
        )
    ),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in alnum_words(t.text.encode()))


def weights(df: dict[bytes, int], n: int, vocab: frozenset[bytes]) -> dict[bytes, float]:
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocab}


def idf(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF of each template word over all documents; as many rows as the templates have words, whatever the table's size."""
    vocab = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                df.update(vocab.intersection(alnum_words(text)))
                n += 1
        df[b""] = n
        yield batch("word string,df long", [[w.decode() for w in df], list(df.values())])

    rows = narrowed(docs, docs.columns[0], text_col).select("text").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {r["word"].encode(): r["df"] for r in rows.collect()}  # bounded by the templates' words
    n = df.pop(b"", 0)
    return weights(df, n, vocab)


@dataclass(frozen=True)
class Entry:
    """A template in the index: its words, phrases with their positions, the positions of its rarer half, votes it needs, its band."""

    template: Template
    words: list[bytes]
    names: list[tuple[int, list[bytes]]]
    keys: list[tuple[int, list[bytes]]]
    rare: frozenset[int]
    need: int
    band: int


def _phrases(words: list[bytes], phrases: tuple[str, ...]) -> list[tuple[int, list[bytes]]]:
    each = [alnum_words(p.encode()) for p in phrases]
    return [(next(i for i in range(len(words)) if words[i : i + len(p)] == p), p) for p in each]


class Index:
    """Postings of the templates' words."""

    def __init__(self, templates: tuple[Template, ...], weights: dict[bytes, float]):
        self.weights = weights
        self.entries: list[Entry] = []
        #: word -> positions, for each template
        self.postings: list[dict[bytes, list[int]]] = []
        #: words of a rarer half -> templates; base words -> (template, position)
        self.triggers: dict[bytes, list[int]] = {}
        self.base: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            words = alnum_words(t.text.encode())
            half = (len(words) + 1) // 2
            order = sorted(range(len(words)), key=lambda i: (-weights.get(words[i], 0.0), i))  # noqa: B023
            rare = frozenset(order[:half])
            self.entries.append(Entry(t, words, _phrases(words, t.names), _phrases(words, t.key), rare, min(VOTES, half), max(BAND, len(words) // 8)))
            own: dict[bytes, list[int]] = {}
            for j, w in enumerate(words):
                own.setdefault(w, []).append(j)
            self.postings.append(own)
            if t.base:
                self.base.setdefault(words[order[0]], []).append((k, order[0]))
            else:
                for w in {words[j] for j in rare}:
                    self.triggers.setdefault(w, []).append(k)
        self.vocabulary = frozenset(w for own in self.postings for w in own)
        self.first = frozenset(self.triggers) | frozenset(self.base)

    def looked_up(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Places of the words that are looked up: of each stretch those of highest IDF."""
        places: dict[bytes, list[int]] = {}
        for start in range(0, len(words), STRETCH):
            some = words[start : start + STRETCH]
            own = self.vocabulary.intersection(some)
            if len(own) > TOP:
                own = set(sorted(own, key=lambda w: (-self.weights.get(w, 0.0), w))[:TOP]) | (own & self.base.keys())
            for i, w in enumerate(some, start):
                if w in own:
                    places.setdefault(w, []).append(i)
        return places

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, score) for every place."""
        if self.first.isdisjoint(words):
            return []
        places = self.looked_up(words)
        found = []
        for w in self.base.keys() & places.keys():
            for k, j in self.base[w]:
                own = self.entries[k].words
                found += [(k, i - j, 1.0) for i in places[w] if i >= j and words[i - j : i - j + len(own)] == own]
        for k in {k for w in self.triggers.keys() & places.keys() for k in self.triggers[w]}:
            votes = sorted((i - j, j) for w, own in self.postings[k].items() for i in places.get(w, ()) for j in own)
            found += self.agreed(k, votes, words)
        return sorted(found)

    def agreed(self, k: int, votes: list[tuple[int, int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        """Places of a template at which enough votes agree, from left to right; votes that made a place are used up."""
        e, found = self.entries[k], []
        here: Counter[int] = Counter()
        rare = a = b = 0
        while a < len(votes):
            while b < len(votes) and votes[b][0] <= votes[a][0] + e.band:
                j = votes[b][1]
                here[j] += 1
                rare += j in e.rare
                b += 1
            stop = a + 1
            if len(here) >= e.need and rare and (place := self.fit(e, words, votes[a][0])):
                found.append((k, *place))
                stop = b
            while stop < len(votes) and votes[stop][0] == votes[a][0] and stop < b:  # the same offset is tried once
                stop += 1
            for _, j in votes[a:stop]:
                rare -= j in e.rare
                here[j] -= 1
                if not here[j]:
                    del here[j]
            a = stop
        return found

    def fit(self, e: Entry, words: list[bytes], d: int) -> tuple[int, float] | None:
        """Where a template's first phrase stands if it begins about word d, and its score; None if it is not there."""
        at = None
        for j, p in e.names:
            x = verbatim(words, p, d + j - e.band, d + j + 2 * e.band)
            if x is None:
                return None
            at = x if at is None else at
        for j, p in e.keys:
            x = edited(words, p, d + j - e.band, d + j + 2 * e.band)
            if x is None:
                return None
            at = x if at is None else at
        score = in_order(e.words, words[max(0, d - e.band) : max(0, d + len(e.words) + 2 * e.band)]) / len(e.words)
        return (at, score) if score >= SHARE else None


def verbatim(words: list[bytes], phrase: list[bytes], low: int, high: int) -> int | None:
    """The first word from `low` to `high` at which the phrase stands as it is."""
    for x in range(max(0, low), min(high, len(words) - len(phrase)) + 1):
        if words[x] == phrase[0] and words[x : x + len(phrase)] == phrase:
            return x
    return None


def edited(words: list[bytes], phrase: list[bytes], low: int, high: int) -> int | None:
    """The last word of the first place from `low` on, and at most `high` words plus the phrase further, where it stands with few edits.

    One row of a banded alignment for each word of the text; a place may begin anywhere.
    """
    most = len(phrase) // EDIT
    some = words[max(0, low) : max(0, high + len(phrase) + most)]
    last = list(range(len(phrase) + 1))
    before = last
    for i, w in enumerate(some):
        row = [0]
        for j, p in enumerate(phrase, 1):
            cost = min(last[j - 1] + (w != p), last[j] + 1, row[j - 1] + 1)
            if i and j > 1 and w == phrase[j - 2] and some[i - 1] == p:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if row[-1] <= most:
            return max(0, low) + i
        before, last = last, row
    return None


def in_order(template: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, as the longest rising run of matched places."""
    places: dict[bytes, list[int]] = {}
    for i in range(len(words) - 1, -1, -1):
        places.setdefault(words[i], []).append(i)
    tops: list[int] = []
    for w in template:
        for i in places.get(w, ()):  # from the last place to the first, so that one word is used once
            k = bisect_left(tops, i)
            tops[k : k + 1] = [i]
    return len(tops)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score, and places (label:word)."""
    index = Index(templates, idf(docs, text_col, templates))
    schema = (
        f"doc_id {id_type(docs, id_col)},n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double,places string"
    )

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in part.column("text").to_pylist():
            words = alnum_words(text)
            found = [(index.entries[k].template, s, x) for k, s, x in index.scan(words)]
            base = [s for t, s, _ in found if t.base]
            names = lambda some: ",".join(sorted({t.label for t, _, _ in some}))
            rows.append((
                len(words), len(base), min(base, default=None), max(base, default=None), names(x for x in found if x[0].base), names(found),
                max((x for _, _, x in found), default=0.0), " ".join(f"{x}:{s}" for s, x in sorted({(s, t.label) for t, s, _ in found})),
            ))
        return batch(schema, list(zip(*rows, strict=True)), part.column("doc_id"))

    return mapped(narrowed(docs, id_col, text_col), kernel, schema)
