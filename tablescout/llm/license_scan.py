"""License scans: whole notices as templates with optional and replaceable regions, compiled into
automata over words, which accept where all mandatory wording stands exactly."""

from __future__ import annotations

import re
from functools import lru_cache
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, once

# Phrases and labels of the base scan.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of public license notices as words. [[...]] is optional, {{n}} stands for up
# to n words of any kind (names), a|b for either word. || ends the opening: all of a notice must stand
# for its label, the opening alone gives the label with "-opening". A notice starts with a mandatory word.
_BSD_1 = "[[1|a|i]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_2 = "[[2|b|ii]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "neither the name of {{12}} nor the names of its|his|her|their contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_ADVERTISING = "[[3|c|iii]] all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment this product includes software developed by {{20}}"
_BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_END = (
    "this software is provided by {{12}} as|“as is|is” and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_MIT_END = (
    "the software is provided as|“as is|is” without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors|author or copyright holders|holder be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_PERMISSIVE_END = (
    "the software is provided as|“as is|is” and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_GNU = (
    "free software you can redistribute it and or modify it under the terms of the gnu NAME as published by the free software foundation [[either]] version VERSION of the license [[or at your option any later version]] || "
    "{{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu NAME for more details"
)
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction || including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _MIT_END),
    ("bsd-2-clause", f"{_BSD_OPENING} || {_BSD_1} {_BSD_2} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_OPENING} || {_BSD_1} {_BSD_2} [[3|c|iii]] {_BSD_NAMES} {_BSD_END}"),
    ("bsd-4-clause", f"{_BSD_OPENING} || {_BSD_1} {_BSD_2} {_BSD_ADVERTISING} [[4|d|iv]] {_BSD_NAMES} {_BSD_END}"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted || provided that the above copyright notice and this permission notice appear in all copies " + _PERMISSIVE_END),
    ("0bsd", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted || " + _PERMISSIVE_END),
    ("zlib", "this software is provided as|‘as is|is’ without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software || permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain || anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0 [[txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as|“as is|is” basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v|version 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http|https mozilla org mpl 2 0"),
    ("gpl-2.0", _GNU.replace("NAME", "general public license").replace("VERSION", "2")),
    ("gpl-3.0", _GNU.replace("NAME", "general public license").replace("VERSION", "3")),
    ("lgpl-2.1", _GNU.replace("NAME", "lesser general public license").replace("VERSION", "2 1")),
    ("lgpl-3.0", _GNU.replace("NAME", "lesser general public license").replace("VERSION", "3")),
    ("agpl-3.0", _GNU.replace("NAME", "affero general public license").replace("VERSION", "3")),
    ("proprietary", "copyright [[c|©]] {{3}} [[by]] {{8}} all rights reserved"),
]

# Sentences that name a license without its wording; their labels end in "-mention".
_UNDER = "licensed|released|distributed|available under [[the terms of]]"
MENTIONS = [
    ("apache-2.0", f"{_UNDER} the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("agpl-3.0", "gnu affero general public license [[as published by the free software foundation]] version 3"),
    ("gpl-3.0", f"{_UNDER} the gnu general public license version 3"),
    ("gpl-2.0", f"{_UNDER} the gnu general public license version 2"),
    ("lgpl", "gnu lesser|library general public license"),
    ("cc-by-4.0", f"{_UNDER} [[a|the]] cc by 4 0"),
    ("cc-by-nc-4.0", f"{_UNDER} [[a|the]] cc by nc 4 0"),
    ("cc-by-sa-4.0", f"{_UNDER} [[a|the]] cc by sa 4 0"),
    ("cc-by-nd-4.0", f"{_UNDER} [[a|the]] cc by nd 4 0"),
    ("cc-by-4.0", f"{_UNDER} [[a|the]] creative commons attribution 4 0 international [[public]] license"),
    ("cc-by-sa-4.0", f"{_UNDER} [[a|the]] creative commons attribution sharealike 4 0 international [[public]] license"),
    ("cc-by-nc-4.0", f"{_UNDER} [[a|the]] creative commons attribution noncommercial 4 0 international [[public]] license"),
    ("cc0-1.0", "cc0 1 0 universal"),
    ("mit", f"{_UNDER} the mit license"),
    ("bsd", f"{_UNDER} the [[2|3|4]] [[clause]] bsd license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v|version 2 0"),
]

# Words that deny the mention that they stand before, and words that may stand between.
DENIALS = frozenset("not never no cannot isn aren wasn isn’t aren’t wasn’t neither nor".encode().split())
BETWEEN = frozenset(b"t be been being currently yet longer now the a".split())

#: Scores by kind: the whole wording, its opening alone, a sentence that names the license.
SCORES = {"notice": 1.0, "opening": 0.7, "mention": 0.6}

# The bytes that do not belong to words; A-Z become a-z first.
_BREAKS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in _BREAKS else b for b in range(256)
)


class Automaton:
    """States in a row; from each, words lead on, and free moves skip what may be absent."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, list[int]]] = [{}]  # by word; b"" stands for any word
        self.free: list[list[int]] = [[]]
        optional: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                optional.append(len(self.steps) - 1)
            elif part == "]]":
                self.free[optional.pop()].append(len(self.steps) - 1)
            elif part.startswith("{{"):
                first, n = len(self.steps) - 1, int(part[2:-2])
                for _ in range(n):
                    self._add([b""])
                for i in range(n):
                    self.free[first + i].append(len(self.steps) - 1)
            else:
                self._add([w.encode() for w in part.split("|")])
        self.last = len(self.steps) - 1
        self.begins = {w for s in self._closed({0}) for w in self.steps[s]}
        if template.startswith(("[[", "{{")):
            raise ValueError(f"a template starts with a mandatory word: {template}")

    def _add(self, words: list[bytes]) -> None:
        self.steps.append({})
        self.free.append([])
        for w in words:
            self.steps[-2].setdefault(w, []).append(len(self.steps) - 1)

    def _closed(self, states: set[int]) -> set[int]:
        queue = list(states)
        while queue:
            for s in self.free[queue.pop()]:
                if s not in states:
                    states.add(s)
                    queue.append(s)
        return states

    def accept(self, words: list[bytes], at: int) -> int | None:
        """Position past the longest notice that starts at ``at``; None if there is none."""
        states, found = self._closed({0}), None
        for i in range(at, len(words)):
            moved = set()
            for s in states:
                moved.update(self.steps[s].get(words[i], ()))
                moved.update(self.steps[s].get(b"", ()))
            states = self._closed(moved)
            if not states:
                break
            if self.last in states:
                found = i + 1
        return found


Templates = tuple[tuple[str, str], ...]


@lru_cache(4)
def _compiled(notices: Templates, mentions: Templates) -> dict[bytes, list[tuple[str, str, Automaton]]]:
    """(kind, label, automaton) by the words that they start with."""
    by_word: dict[bytes, list[tuple[str, str, Automaton]]] = {}
    wanted = [("mention", f"{label}-mention", text) for label, text in mentions]
    openings: dict[str, list[str]] = {}
    for label, text in notices:
        wanted.append(("notice", label, text.replace("||", " ")))
        if "||" in text:
            openings.setdefault(text.split("||")[0], []).append(label)
    for text, labels in openings.items():
        # Notices that open alike are named by what their labels share, as bsd.
        shared = "-".join(commonprefix([label.split("-") for label in labels]))
        wanted += [("opening", f"{label}-opening", text) for label in ([shared] if shared else labels)]
    for kind, label, text in wanted:
        one = Automaton(text)
        for w in one.begins:
            by_word.setdefault(w, []).append((kind, label, one))
    return by_word


def _denied(words: list[bytes], at: int) -> bool:
    """Whether a denial stands before the sentence at ``at``, as in "not yet released under"."""
    at -= 1
    while at >= 0 and words[at] in BETWEEN:
        at -= 1
    return at >= 0 and words[at] in DENIALS


def _places(joined: bytes, phrase: bytes):
    """Word numbers where ``phrase`` starts; ``joined`` has one blank around every word."""
    sought, at, number, last = b" " + phrase + b" ", joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        number += joined.count(b" ", last, at)
        last = at
        yield number
        at = joined.find(sought, at + 1)


def scan(text: str | None, notices: Templates, mentions: Templates) -> tuple:
    """Words, base places, their first and last word, base labels, all labels, score, matches."""
    folded = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not folded:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" " + b" ".join(folded) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        found = list(_places(joined, phrase.encode()))
        if found:
            base.add(label)
            places += found
    matches = set()
    for word, automata in _compiled(notices, mentions).items():
        for at in _places(joined, word):
            for kind, label, one in automata:
                past = one.accept(folded, at)
                if past is not None and not (kind == "mention" and _denied(folded, at)):
                    matches.add((at, past, label, kind))
    matches = _outermost(sorted(matches))
    labels = base | {m[2] for m in matches}
    return (
        len(folded), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)),
        max([SCORES[m[3]] for m in matches], default=0.5 if base else 0.0),
        [{"first": m[0], "past": m[1], "label": m[2]} for m in matches],
    )


def _outermost(matches: list[tuple]) -> list[tuple]:
    """Without the openings and mentions inside a whole notice; matches come by their start."""
    kept, past = [], 0
    for m in sorted(matches, key=lambda x: (x[0], x[3] != "notice")):
        if m[3] == "notice":
            past = max(past, m[1])
        elif m[1] <= past:
            continue
        kept.append(m)
    return sorted(kept)


RESULTS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
    "base_labels": "string", "labels": "string", "score": "double",
    "matches": "array<struct<first:long,past:long,label:string>>",
}


def licenses(
    df: DataFrame,
    text: str = "text",
    columns: list[str] | None = None,
    notices: list[tuple[str, str]] = NOTICES,
    mentions: list[tuple[str, str]] = MENTIONS,
) -> DataFrame:
    """``df`` (or ``columns`` of it) with what every whole text says about its license.

    Base columns count the places of fixed phrases. ``matches`` are the ranges of words that a
    template accepts: whole notices (score 1), openings of notices whose further wording is missing
    or changed (``-opening``, 0.7), and sentences that name a license (``-mention``, 0.6; none where
    denied). ``labels`` joins the labels of both; the score is the highest, 0.5 where only a phrase
    stands, else 0. What is written after a whole notice is not part of it.

    A null text counts as empty, with
    null first and last word. Input columns of the result names are replaced; repeated rows
    stay; an empty table gives an empty table.
    """
    fixed = tuple(notices), tuple(mentions)

    def found(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([scan(t, *fixed) for t in texts], columns=list(RESULTS), dtype=object)
        return rows.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    kind = ", ".join(f"{k} {v}" for k, v in RESULTS.items())
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in RESULTS]
    held = attach(df, {"_v": once(found, kind)(F.col(f"`{text}`"))}, kept)
    return held.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_v.{c}").alias(c) for c in RESULTS])
