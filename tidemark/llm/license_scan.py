"""Licence scan with a positional index of rare licence words.

The library holds whole licence texts and the notices by which works name one.  Each template has
mandatory phrases; its anchors are the rarest words of those phrases, by inverse document
frequency over the library, with their positions.  A file looks up its licence words, rarest
first: the first anchor of a template opens the shifts (position in the file less position in
the template) at which the template may stand, and each further anchor intersects them; a
template without shifts is given up.  What is left is verified: every mandatory phrase must
stand in the file at that shift, in full.  Since all anchors lie in mandatory phrases, no
template whose phrases stand in place is lost, however much of the rest is missing.

Defined results: a null text is an empty text, with no words and no labels; repeated rows are
scanned row by row; columns other than the id and the text are ignored.  The phrase labels
(base) stay whatever the index adds.  `score` is the largest share of a verified template's words
that stand in place, and 1 for a phrase label.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrow import map_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The phrases that label a file by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence texts, and notices by which a work names its licence.
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"
BOOST = "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"
MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"
CC0 = "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal"
#: Label, template, and the phrases of it that must stand in the file.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", APACHE, ("you may not use this file except in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", MIT, ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",)),
    ("isc", ISC, ("permission to use copy modify and or distribute",)),
    ("bsd", BSD, ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("zlib", ZLIB, ("permission is granted to anyone to use this software for any purpose",)),
    ("boost", BOOST, ("permission is hereby granted free of charge to any person or organization",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", GPL, ("gnu general public license as published by",)),
    ("lgpl", GPL.replace("gnu general", "gnu lesser general"), ("gnu lesser general public license",)),
    ("agpl", GPL.replace("gnu general", "gnu affero general"), ("gnu affero general public license",)),
    ("mpl-2.0", MPL, ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", CC0, ("cc0 1 0",)),
    ("unlicense", UNLICENSE, ("free and unencumbered software",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
#: Anchors of a template at most.
ANCHORS = 4


class Index:
    """idf of the library's words; postings: of a word, the templates that it anchors and its positions there."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in templates]
        held = Counter(w for _, words, _ in self.templates for w in set(words))
        self.idf = {w: math.log((1 + len(self.templates)) / n) for w, n in held.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = [0] * len(self.templates)
        self.phrases: list[list[tuple[int, list[bytes]]]] = []
        for t, (_, words, phrases) in enumerate(self.templates):
            # Of a phrase that stands in the template more than once the first place counts.
            firsts = [next(k for k in range(len(words)) if words[k : k + len(p)] == p) for p in phrases]
            places = {k for at, p in zip(firsts, phrases, strict=True) for k in range(at, at + len(p))}
            chosen = sorted(places, key=lambda k: (-self.idf[words[k]], k))[:ANCHORS]
            for at in chosen:
                self.postings[words[at]].append((t, at))
            self.anchors[t] = len(chosen)
            self.phrases.append(list(zip(firsts, phrases, strict=True)))

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, share of the template's words found there) of every verified template."""
        spots: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                spots.setdefault(w, []).append(i)
        shifts: dict[int, list[int]] = {}
        met: Counter[int] = Counter()
        for w in sorted(spots, key=lambda w: (-self.idf[w], w)):
            for t, at in self.postings[w]:
                if t not in shifts:
                    shifts[t] = [i - at for i in spots[w]]
                elif shifts[t]:
                    shifts[t] = [s for s in shifts[t] if 0 <= s + at < len(words) and words[s + at] == w]
                met[t] += 1
        out = []
        for t, found in shifts.items():
            if met[t] < self.anchors[t]:
                continue
            label, template, _ = self.templates[t]
            for shift in found:
                if all(shift + at >= 0 and words[shift + at : shift + at + len(p)] == p for at, p in self.phrases[t]):
                    same = sum(0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(template))
                    out.append((label, max(shift, 0), same / len(template)))
        return out


BASE = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])"), label) for p, label in PHRASES.items()]


def scan(text: str, index: Index) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    data = text.encode().lower()
    words = WORD.findall(data)
    spots: list[int] = []
    base: set[str] = set()
    if b"by" in data or b"public" in data or b"reserved" in data:
        starts: list[int] | None = None
        for pattern, label in BASE:
            for m in pattern.finditer(data):
                starts = starts or [x.start() for x in WORD.finditer(data)]
                spots.append(bisect_right(starts, m.start()) - 1)
                base.add(label)
    found = index.matches(words)
    labels = base | {label for label, _, _ in found}
    score = max([share for _, _, share in found] + [1.0] * bool(base), default=0.0)
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), sorted(base), sorted(labels), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels (comma-joined) and score."""
    kind = docs.schema[id_col].dataType.simpleString()
    index = Index(templates)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = list(zip(*[scan(t or "", index) for t in batch.column(1).to_pylist()], strict=True))
        columns = [pa.array(x, pa.int64()) for x in told[:4]] + [pa.array([",".join(x) for x in part], pa.string()) for part in told[4:6]] + [pa.array(told[6], pa.float64())]
        return pa.record_batch([batch.column(0), *columns], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
