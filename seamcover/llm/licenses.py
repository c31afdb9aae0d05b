"""License scan by a positional rare-token index.

Templates are word sequences with a label: short phrases, which have to stand as they are, and whole licence texts and
notices, which may differ in some words. Every template word's document frequency is counted over all texts. A template
is posted under its rarest words (highest IDF) with their positions in it: ANCHORS of a phrase, TEXT_ANCHORS of a text.

A text is asked for the posted words that it holds; word w of template position p at text position t speaks for the
start t - p. For a phrase the starts of all its anchors are intersected, the rarest first, and the words in place are
then compared. For a licence text the starts are counted in windows of SLACK words, as words may be missing or put in
(a name, a year); a window that holds the share LEAST of the anchors' weight is a candidate, and is a match if each of
the template's mandatory key phrases stands there, from SLACK words before it to SLACK words behind its last word.

Words: A-Z is lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Places may overlap; all are found.
score: 1 for a text that holds a phrase, else the greatest weight share of a matching licence text, or of a window or
phrase that doesn't match, halved.

Edge cases: a null or blank text has no words: n_words 0, null first and last word, empty labels, score 0. Repeated rows
are scanned alike, very long texts whole. Kept columns of the results' names are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.llm.common import add_columns, alnum_words, emit, read_table, shared, slices

ANCHORS, TEXT_ANCHORS = 3, 32
#: Words by which a licence text may be moved against its template, and the share of its anchors' weight it has to hold.
SLACK, LEAST = 24, 0.6
#: The phrases whose places are counted, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further phrases of well-known licence texts and notices.
MORE = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "licensed under the apache license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "cc by sa": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
    "boost software license version 1 0": "bsl-1",
}
#: Published licence texts and notices (label, text, mandatory key phrases).
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""", ("to deal in the software without restriction", "this permission notice shall be included")),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
        ("redistributions in binary form must reproduce", "may be used to endorse or promote products")),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES ARE DISCLAIMED.""", ("redistributions of source code must retain", "provided with the distribution this software is provided")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""", ("for any purpose with or without fee", "appear in all copies")),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""", ("except in compliance with the license", "governing permissions and limitations under the license")),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license as published by the free software foundation", "in the hope that it will be useful")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
        ("gnu lesser general public license as published by the free software foundation",)),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("subject to the terms of the mozilla public license",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""", ("unencumbered software released into the public domain",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution.""",
        ("the origin of this software must not be misrepresented", "may not be removed or altered from any source distribution")),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so.""", ("any person or organization obtaining a copy", "to prepare derivative works of the software")),
)
FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


@dataclass
class Template:
    """``keys``: mandatory phrases of a licence text; a template without them is a phrase and has to stand whole."""

    words: list[bytes]
    label: str
    base: bool
    keys: list[list[bytes]] = field(default_factory=list)


def templates(base: dict[str, str] = BASE, more: dict[str, str] = MORE, texts: tuple = TEXTS) -> list[Template]:
    phrases = [Template(k.encode().split(), v, own) for some, own in ((base, True), (more, False)) for k, v in some.items()]
    return phrases + [Template(alnum_words(t.encode()), label, False, [k.encode().split() for k in keys]) for label, t, keys in texts]


class Index:
    """Templates posted under their rarest words; ``idf`` by licence word."""

    def __init__(self, data: tuple[list[Template], dict[bytes, float]]):
        self.templates, self.idf = data
        self.anchors: list[list[tuple[int, bytes]]] = []
        for t in self.templates:
            rare = sorted(range(len(t.words)), key=lambda p: (-self.idf[t.words[p]], p))
            self.anchors.append([(p, t.words[p]) for p in rare[: TEXT_ANCHORS if t.keys else ANCHORS]])
        self.weight = [sum(self.idf[w] for _, w in a) for a in self.anchors]
        self.rarest: dict[bytes, list[int]] = {}  # phrases by their rarest word, texts by every anchor
        for k, a in enumerate(self.anchors):
            for w in dict.fromkeys(w for _, w in (a if self.templates[k].keys else a[:1])):
                self.rarest.setdefault(w, []).append(k)
        self.words = {w for a in self.anchors for _, w in a}

    def places(self, words: list[bytes]) -> tuple[dict[int, list[int]], float]:
        """Starts of each template found in a text, and its score."""
        held = self.words.intersection(words)
        if not held:
            return {}, 0.0
        lists: dict[bytes, list[int]] = {w: [] for w in held}
        for i, w in enumerate(words):
            if w in held:
                lists[w].append(i)
        at = {w: np.array(x, np.int64) for w, x in lists.items()}
        found, score = {}, 0.0
        for k in dict.fromkeys(k for w in sorted(held, key=lambda x: (-self.idf[x], x)) for k in self.rarest.get(w, ())):
            starts, share = (self._text if self.templates[k].keys else self._phrase)(k, words, at)
            if starts:
                found[k] = starts
            score = max(score, share)
        return found, score

    def _phrase(self, k: int, words: list[bytes], at: dict[bytes, np.ndarray]) -> tuple[list[int], float]:
        t, anchors = self.templates[k], self.anchors[k]
        starts = at[anchors[0][1]] - anchors[0][0]
        starts = starts[(starts >= 0) & (starts + len(t.words) <= len(words))]
        share = np.full(len(starts), self.idf[anchors[0][1]])
        for p, w in anchors[1:]:
            share += self.idf[w] * np.isin(starts, at.get(w, np.zeros(0, np.int64)) - p)
        whole = [s for s in starts[share > self.weight[k] - 1e-9].tolist() if words[s : s + len(t.words)] == t.words]
        return whole, 1.0 if whole else float(share.max(initial=0.0)) / self.weight[k] / 2

    def _text(self, k: int, words: list[bytes], at: dict[bytes, np.ndarray]) -> tuple[list[int], float]:
        """Windows of starts, each SLACK long and half over the next; an anchor counts once in a window."""
        t, anchors = self.templates[k], self.anchors[k]
        mine = [(i, at[w] - p) for i, (p, w) in enumerate(anchors) if w in at]
        if sum(self.idf[anchors[i][1]] for i, _ in mine) < LEAST * self.weight[k]:
            return [], 0.0
        half, n = SLACK // 2, len(anchors)
        window = np.concatenate([s // half for _, s in mine])
        anchor = np.concatenate([np.full(len(s), i) for i, s in mine])
        pair = np.unique(np.concatenate([window, window - 1]) * n + np.tile(anchor, 2))
        kinds, place = np.unique(pair // n, return_inverse=True)
        weights = np.array([self.idf[w] for _, w in anchors])
        share = np.bincount(place.reshape(-1), weights[pair % n]) / self.weight[k]
        starts, best = [], float(share.max(initial=0.0)) / 2
        for w in np.flatnonzero(share >= LEAST):
            first = int(kinds[w]) * half
            here = b" " + b" ".join(words[max(0, first - SLACK) : max(0, first + 2 * half + len(t.words) + SLACK)]) + b" "
            if all(b" " + b" ".join(key) + b" " in here for key in t.keys):
                if not starts or first - starts[-1] > len(t.words):
                    starts.append(max(0, first))
                best = max(best, float(share[w]))
        return starts, best

    def __call__(self, texts: list[bytes | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in FIELDS}
        for text in texts:
            words = alnum_words(text or b"")
            found, score = self.places(words)
            starts = [s for k, x in found.items() if self.templates[k].base for s in x]
            values = (
                len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({self.templates[k].label for k in found if self.templates[k].base})), ",".join(sorted({self.templates[k].label for k in found})), score,
            )
            for name, value in zip(FIELDS, values, strict=True):
                out[name].append(value)
        return out


def inverse_document_frequency(df: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, float]:
    """log((1 + texts) / (1 + texts with the word)) + 1 of each licence word, over all texts; one row a word reaches the driver."""

    def count(batches):
        held, n = Counter(), 0
        for batch in batches:
            for _, texts in slices(batch, text):
                n += len(texts)
                for t in texts:
                    held.update(words.intersection(alnum_words(t or b"")))
        yield {"word": pa.array([*held, b""], pa.binary()), "n": pa.array([*held.values(), n], pa.int64())}

    found = {bytes(r.word): r.n for r in emit(df.select(text), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = found.get(b"", 0)
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) + 1 for w in words}


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, phrases: list[Template] | None = None) -> DataFrame:
    """``df``'s kept columns with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    phrases = templates() if phrases is None else phrases
    idf = inverse_document_frequency(df, {w for t in phrases for w in t.words}, text)  # a few hundred words
    index = shared(df.sparkSession, (phrases, idf), Index)
    return add_columns(df, text, lambda texts: index()(texts), FIELDS, keep)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
