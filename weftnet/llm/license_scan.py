"""License scans by template-markup matching.

A template is licence wording with optional regions `[[...]]` and replaceable regions `{{1-12}}` (how many
words may stand there). It compiles to a token automaton: a state per mandatory word, skips over optional
regions, self-loops with a bound for replaceable ones. A text has the template's label where the automaton
accepts, that is, where all mandatory wording stands exactly and in order. Phrases give the base labels.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lowered. Null and empty
texts have no words, no labels, null places and score 0. Null doc_ids and repeated rows are scanned like
any other row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, text_slices

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Parts of published licences that several of them share.
_BSD_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_DISCLAIMER = "this software is provided by {{2-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{2-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"

#: Published licence wording with markup.
TEMPLATES = {
    "mit-notice": "[[this work is]] {released|licensed|distributed|available} under the [[terms of the]] [[expat]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{2-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0": "[[this work is]] {licensed|released|distributed} under the [[terms of the]] apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use {{1-4}} except in compliance with the license you may obtain a copy of the license at {{1-12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "[[this {{1-3}} is]] {licensed|released|distributed} under the [[terms of the]] gnu general public license [[version {{1-2}}]]",
    "gpl-header": "this {{1-4}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1-2}} of the license or at your option any later version",
    "cc-by-4.0": "{licensed|released|available} under [[a|the]] [[creative commons]] cc by {4|3|2} {0|5} [[international]] [[license]]",
    "cc-by-sa": "[[licensed under]] [[a|the]] cc by sa {{1-2}}",
    "cc-by-nc": "[[licensed under]] [[a|the]] cc by nc {{1-2}}",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{2-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{2-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} [[3]] neither the name of {{{{1-12}}}} nor the names of {{{{1-4}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{1-8}} mpl 2 0",
    "gpl-file-notice": "this {{1-4}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1-2}} of the license or at your option any later version this {{1-4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this {{1-4}} if not {see|write} {{1-24}}",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-text": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS} and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software [[for more information please refer to {{{{1-6}}}}]]",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {{2-12}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an {acknowledgment|acknowledgement} in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "bsl-1.0": f"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor {_AS_IS} title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}

#: Other bytes than word bytes become spaces; A-Z are lowered.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

REPORT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))]
)


class Automaton:
    """Token automaton of one template: states are numbered, 0 is the start."""

    def __init__(self, template: str) -> None:
        self.moves: list[dict[bytes, set[int]]] = [{}]
        self.loose: list[set[int]] = [set()]  # reached by any word
        self.skips: list[set[int]] = [set()]  # reached by no word
        marks = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\{[^{}]+\}|\||[^\s\[\]{}|]+", template.lower())
        at, opened, words = 0, [], []
        for mark in marks:
            if mark == "[[":
                opened.append((at, []))
            elif mark == "|":
                start, ends = opened[-1]
                ends.append(at)
                at = self._state(start)
            elif mark == "]]":
                start, ends = opened.pop()
                at = self._state(start, at, *ends)
            elif mark.startswith("{{"):
                least, most = map(int, mark[2:-2].split("-"))
                early = []
                for k in range(most):
                    to = self._state()
                    self.loose[at].add(to)
                    at = to
                    if k + 1 >= least:
                        early.append(at)
                at = self._state(*early)
            else:
                to = self._state()
                for word in mark.strip("{}").split("|"):
                    self.moves[at].setdefault(word.encode(), set()).add(to)
                at = to
                if not opened and mark[0] != "{":
                    words.append(mark.encode())
        self.end = at
        self.anchor = max(words, key=lambda w: (w != b"under", len(w)))  # a mandatory word that few texts have
        self.close = [self._closure(k) for k in range(len(self.moves))]
        self.first = {w for k in self.close[0] for w in self.moves[k]} if not any(self.loose[k] for k in self.close[0]) else None

    def _state(self, *frm: int) -> int:
        """A new state that the given ones reach without a word."""
        self.moves.append({})
        self.loose.append(set())
        self.skips.append(set())
        for k in frm:
            self.skips[k].add(len(self.moves) - 1)
        return len(self.moves) - 1

    def _closure(self, k: int) -> frozenset[int]:
        seen, todo = {k}, [k]
        while todo:
            for to in self.skips[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from start."""
        live, best = set(self.close[0]), None
        for at in range(start, len(words) + 1):
            if self.end in live and at > start:
                best = at
            if at == len(words) or not live:
                break
            to: set[int] = set()
            for k in live:
                for n in self.moves[k].get(words[at], ()):
                    to |= self.close[n]
                for n in self.loose[k]:
                    to |= self.close[n]
            live = to
        return best

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted runs from left to right, none overlapping another."""
        runs, at = [], 0
        while at < len(words):
            end = self.match(words, at) if self.first is None or words[at] in self.first else None
            if end:
                runs.append((at, end))
            at = end or at + 1
        return runs


def _places(words: list[bytes], phrase: list[bytes]) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if words[at : at + len(phrase)] == phrase:
            yield at


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Labels, places and spans of each row of docs(doc_id, text)."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base = [(p.encode().split(), label, b" %b " % max(p.encode().split(), key=len)) for p, label in phrases.items()]
        automata = [(label, a, b" %b " % a.anchor) for label, t in templates.items() for a in (Automaton(t),)]
        for batch, texts in text_slices(batches):
            rows: dict[str, list] = {f.name: [] for f in REPORT}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                plain = b" %b " % text.translate(TABLE)
                words = plain.split()
                found = [(at, label, len(p)) for p, label, mark in base if mark in plain for at in _places(words, p)]
                spans = sorted((a, b, label) for label, m, mark in automata if mark in plain for a, b in m.find(words))
                inside = sum(any(a <= at and at + n <= b for a, b, _ in spans) for at, _, n in found)
                labels = {x[1] for x in found}
                row = (doc_id, len(words), len(found), min((x[0] for x in found), default=None), max((x[0] for x in found), default=None),
                       ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in spans})),
                       (0.5 + 0.5 * inside / len(found) if found else 0.75) if found or spans else 0.0, [{"label": x, "first": a, "end": b} for a, b, x in spans])
                for name, x in zip(rows, row, strict=True):
                    rows[name].append(x)
            yield rows

    return arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), report, REPORT)
