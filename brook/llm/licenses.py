"""License scans: templates with optional and replaceable regions as automata over words.

A template is text with markup: `[[words]]` may be missing, `{{n}}` stands for any 0 to n words.
All other words are mandatory and must match exactly, in order. Words are lower-cased (A-Z) runs of
letters, digits and non-ASCII characters, so punctuation and line breaks never matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Phrases and labels of the base count (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Parts that full texts share.
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "[[3]] neither the name of {{12}} nor the names of {{8}} contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_DISCLAIMER = (
    "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies "
_ISC_DISCLAIMER = (
    "the software is provided as is and {{12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)

#: Wording of the licenses (fixed values), with this module's markup. A `-mention` names a license in one line, and what
#: follows may change it.
TEMPLATES = {
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this [[file]] [[work]] except in compliance with the license "
        "you may obtain a copy of the license at {{1}} www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "bsl-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
        "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
        "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "gpl-notice": (
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version "
        "[[this program]] {{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 "
        "if a copy of the mpl was not distributed with this file you can obtain one at {{1}} [[www]] mozilla org mpl 2 0"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ),
    "0bsd": _ISC_GRANT + _ISC_DISCLAIMER,
    "apache-2.0-mention": "licensed under the apache license version 2 [[0]]",
    "bsd-2-clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "cc-by-4.0-mention": "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0",
    "cc-by-nc-4.0-mention": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",
    "cc-by-sa-4.0-mention": "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0",
    "copyright": "copyright [[c]] {{8}} all rights reserved",
    "gpl-2.0-mention": "[[this work is]] licensed under the gnu general public license version 2",
    "gpl-3.0-mention": "[[this work is]] licensed under the gnu general public license version 3",
    "isc": _ISC_GRANT + _ISC_NOTICE + _ISC_DISCLAIMER,
    "mit-mention": "released under the mit license",
    "mit": _MIT,
}

#: End of the labels of one-line claims.
MENTION = "-mention"

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FIND = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str) -> list[bytes]:
    return _FIND.findall(text.encode().translate(_LOWER))


class Automaton:
    """States 0..n-1 stand before the template's words; a gap state also loops on any word."""

    def __init__(self, template: str):
        self.step: list[tuple[str, object]] = []
        for optional, gap, plain in re.findall(r"\[\[(.*?)\]\]|\{\{(\d+)\}\}|([^\[{]+)", template):
            if gap:
                self.step.append(("gap", int(gap)))
            elif words := tokens(optional or plain):
                self.step.append(("optional", words)) if optional else self.step.extend(("word", w) for w in words)

    def first_words(self) -> set[bytes]:
        out: set[bytes] = set()
        for kind, what in self.step:
            if kind == "gap":
                raise ValueError("a template must not begin with a gap")
            out.add(what[0] if kind == "optional" else what)
            if kind == "word":
                return out
        raise ValueError("a template needs a mandatory word")

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """Where an accepted place that starts at word `at` ends, the earliest end; None if there is none."""
        states, ends = {(0, at)}, []
        while states:
            later = set()
            for k, i in states:
                if k == len(self.step):
                    ends.append(i)
                    continue
                kind, what = self.step[k]
                if kind == "word":
                    if i < len(words) and words[i] == what:
                        later.add((k + 1, i + 1))
                elif kind == "optional":
                    later.add((k + 1, i))
                    if words[i : i + len(what)] == what:
                        later.add((k + 1, i + len(what)))
                else:
                    later.update((k + 1, i + n) for n in range(what + 1) if i + n <= len(words))
            states = later
        return min(ends, default=None)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {k: Automaton(v) for k, v in templates.items()}
        self.phrases = [(tokens(p), label) for p, label in phrases.items()]
        rare = {ws[0] for ws, _ in self.phrases}
        self.starts: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first_words():
                self.starts.setdefault(w, []).append(k)
        # a text without any of these words has no place of any kind: each automaton needs its mandatory words
        for a in self.automata.values():
            rare.add(max((what for kind, what in a.step if kind == "word"), key=len))
        self.maybe = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, rare), reverse=True)) + rb")(?![0-9a-z\x80-\xff])")

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode().translate(_LOWER)
        inside = _WORD[np.frombuffer(raw, dtype=np.uint8)]
        n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
        if not self.maybe.search(raw):
            return n_words, 0, None, None, "", "", 0.0
        words = _FIND.findall(raw)
        places: dict[bytes, list[int]] = {}
        wanted = self.starts.keys() | {p[0] for p, _ in self.phrases}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        base: list[tuple[int, str]] = []
        for phrase, label in self.phrases:
            base += [(i, label) for i in places.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
        found = {k for w, ks in self.starts.items() for i in places.get(w, ()) for k in ks if self.automata[k].accepts(words, i) is not None}
        own = {label for _, label in base}
        at = [i for i, _ in base]
        whole = any(not k.endswith(MENTION) for k in found)
        score = 1.0 if whole else 0.75 if found else 0.5 if base else 0.0
        return n_words, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | found)), score


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: the base phrases' places and the labels of the accepted templates.

    score is 1 if the template of a text or notice accepts a place of the text, 0.75 if only that of a
    mention does, 0.5 if only a base phrase stands in it, else 0. Null and empty texts have no words and no labels. Repeated rows give repeated results;
    a null doc_id stays null; other columns are ignored. No rows give no rows."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, phrases)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [(d, *own.scan(x)) for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, RESULT)


def op10_license_templates(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


QUERIES = {"op10_license_templates": op10_license_templates}
ORACLE = {}
