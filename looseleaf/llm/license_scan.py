"""License scans by template-markup matching.

Templates are written in a small markup: plain text is mandatory wording, `[[...]]` an optional region (may
nest) and `<<name:N>>` a replaceable region of at most N words. Each template is compiled into a token automaton:
a nondeterministic automaton over words whose edges are mandatory words, skips over optional regions and bounded
"any word" loops. A text is accepted by a template where the automaton, started at a word that can begin it,
reaches its final state: all mandatory wording then stands there exactly, in order, with nothing but the marked
freedom between. Matching is word-wise over lower-cased ASCII, so layout and punctuation never matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, UPPER, field, map_texts

#: Base phrases: consecutive words and the label they give.
PHRASES = {
    ("under", "the", "mit", "license"): "mit",
    ("apache", "license", "version", "2"): "apache-2",
    ("cc", "by", "nc"): "cc-by-nc",
}

_AS_IS = "is provided <<q:1>> as is <<q:1>> [[,]]"
#: The disclaimers that whole license texts end with.
_MIT_END = (
    f"The Software {_AS_IS} without warranty of any kind, express or implied, including [[,]] but not limited to the warranties of merchantability, "
    "[[,]] fitness for a particular purpose and [[title and]] noninfringement. In no event shall the [[authors or]] [[copyright holders]] [[authors]] be liable for any claim, damages "
    "or other liability, [[,]] whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software [[,]] or the use or other dealings in the Software"
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted [[(subject to the limitations in the disclaimer below)]] provided that the following conditions are met: "
    "[[<<mark:1>>]] Redistributions of source code must retain the above copyright notice, this list of conditions [[,]] and the following disclaimer. "
    "[[<<mark:1>>]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions [[,]] and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "[[<<mark:1>>]] Neither the name [[s]] of <<holder:12>> nor the names of [[its]] [[any]] contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    f"This software {_AS_IS} and any express or implied warranties, including, but not limited to, the implied warranties of merchantability [[,]] and fitness for a particular purpose are disclaimed. "
    "In no event shall <<holder:12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
    "[[,]] loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "[[,]] arising in any way out of the use of this software, even if advised of the possibility of such damage"
).replace("is provided", "is provided by <<holder:12>>")
_MIT_START = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the <<quote:1>> Software <<quote:1>>), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_MIT_MIDDLE = (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software."
)
_ISC_START = (
    "Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies"
)
_GPL_TERMS = "under the terms of [[version <<n:1>> of]] the GNU {} as published by the Free Software Foundation"
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _creative_commons(words: str, short: str) -> list[str]:
    """Notices of one Creative Commons license in each version; what follows its version ends it, so that -ND or -SA aren't passed over."""
    return [f"licensed under {lead} {v} [[International]] [[Unported]]" for v in _CC_VERSIONS for lead in (f"[[a]] [[the]] Creative Commons {words}", f"[[a]] [[the]] CC {short}")]


#: Own wording of widely published notices and license texts, in the template markup: label -> templates. Full texts hold all
#: mandatory wording, so a text with a changed or added condition isn't accepted.
TEMPLATES = {
    "mit": [_MIT_START + _MIT_MIDDLE + _MIT_END, "[[Released]] [[Licensed]] [[Distributed]] under the [[terms of the]] MIT License"],
    "json": [_MIT_START + _MIT_MIDDLE + "The Software shall be used for Good, not Evil." + _MIT_END],
    "isc": [
        _ISC_START + f". The software {_AS_IS} and <<holder:8>> disclaims all warranties with regard to this software [[,]] including all implied warranties of merchantability and fitness. "
        "In no event shall <<holder:8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "[[,]] whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
        "[[Released]] [[Licensed]] under the [[terms of the]] ISC License",
    ],
    "bsd-2-clause": [_BSD_START + _BSD_END, "[[Released]] [[Licensed]] under the [[terms of the]] BSD 2-Clause License"],
    "bsd-3-clause": [_BSD_START + _BSD_NAMES + _BSD_END, "[[Released]] [[Licensed]] under the [[terms of the]] BSD 3-Clause License"],
    "bsd-4-clause": [
        _BSD_START + "[[<<mark:1>>]] All advertising materials mentioning features or use of this software must display the following [[acknowledgement]] [[acknowledgment]]: "
        "This product includes software developed by <<holder:20>>" + _BSD_NAMES + _BSD_END
    ],
    "zlib": [
        "This software is provided <<q:1>> as-is <<q:1>> without any express or implied warranty. In no event [[shall]] [[will]] the authors [[be]] held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "[[<<mark:1>>]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an [[acknowledgment]] [[acknowledgement]] in the product documentation "
        "would be appreciated but is not required. [[<<mark:1>>]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "[[<<mark:1>>]] This notice may not be removed or altered from any source distribution"
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the <<quote:1>> License <<quote:1>>) [[;]] you may not use <<work:2>> file except in compliance with the License [[.]] "
        "You may obtain a copy of the License at <<address:8>> Unless required by applicable law [[,]] or agreed to in writing, software [[,]] distributed under the License is distributed on an <<q:1>> AS IS <<q:1>> basis, "
        "[[,]] without warranties or conditions of any kind, [[,]] either express or implied",
        "Licensed under the Apache License [[,]] Version 2 [[.0]]",
    ],
    "gpl-3": [
        "[[This]] [[<<work:2>> is]] licensed under the GNU General Public License [[as published by the Free Software Foundation]] [[,]] [[either]] version 3",
        _GPL_TERMS.format("General Public License") + ", [[either]] version 3 of the License",
    ],
    "gpl-3-or-later": [_GPL_TERMS.format("General Public License") + ", either version 3 of the License, or (at your option) any later version"],
    "gpl-2": [
        "[[This]] [[<<work:2>> is]] licensed under the GNU General Public License [[as published by the Free Software Foundation]] [[,]] [[either]] version 2",
        _GPL_TERMS.format("General Public License") + "; [[either]] version 2 of the License",
    ],
    "gpl-2-or-later": [_GPL_TERMS.format("General Public License") + "; either version 2 of the License, or (at your option) any later version"],
    "lgpl-2.1": [_GPL_TERMS.format("[[Lesser]] [[Library]] General Public License") + "; [[either]] version 2.1 of the License"],
    "lgpl-3": [_GPL_TERMS.format("Lesser General Public License") + ", [[either]] version 3 of the License"],
    "agpl-3": [_GPL_TERMS.format("Affero General Public License") + ", [[either]] version 3 of the License", "licensed under the GNU Affero General Public License [[,]] version 3"],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<address:8>>",
        "licensed under the [[terms of the]] Mozilla Public License [[,]] [[Version]] [[v]] 2.0",
    ],
    "cc-by": _creative_commons("Attribution", "BY"),
    "cc-by-sa": _creative_commons("Attribution-ShareAlike", "BY-SA"),
    "cc-by-nd": _creative_commons("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-nc": _creative_commons("Attribution-NonCommercial", "BY-NC"),
    "cc-by-nc-sa": _creative_commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "cc-by-nc-nd": _creative_commons("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. " + _MIT_END.replace("and [[title and]] noninfringement", "and noninfringement")
    ],
}
#: Opening clauses: a text that holds one, but not all of its license's wording, is no accepted license; its label says so.
OPENINGS = {"mit-opening": [_MIT_START], "isc-opening": [_ISC_START], "bsd-opening": ["Redistribution and use in source and binary forms, with or without modification, are permitted"]}
_OF_OPENING = {"mit-opening": {"mit", "json"}, "isc-opening": {"isc"}, "bsd-opening": {"bsd-2-clause", "bsd-3-clause", "bsd-4-clause"}}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"\[\[|\]\]|<<\w+:(\d+)>>")
#: Bytes that aren't part of a word become spaces, A-Z becomes a-z; bytes of other characters are word bytes.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LOW = str.maketrans(UPPER, LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z."""
    return text.translate(_TO_WORDS).split()


@dataclass
class Automaton:
    """Token automaton: `words[s]` maps a word to next states, `any[s]` are next states on every word, `skip[s]` on none."""

    label: str
    words: list[dict[bytes, set[int]]] = dc_field(default_factory=list)
    any: list[set[int]] = dc_field(default_factory=list)
    skip: list[set[int]] = dc_field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.skip.append(set())
        return len(self.words) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def firsts(self) -> set[bytes]:
        """Words that can begin a match."""
        return {w for s in self.closed({0}) for w in self.words[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """End (exclusive) of the longest match that begins at `at`, or -1."""
        now, best = self.closed({0}), -1
        for i in range(at, len(words) + 1):
            if self.final in now:
                best = i
            if i == len(words):
                break
            following = {t for s in now for t in (*self.words[s].get(words[i], ()), *self.any[s])}
            if not following:
                break
            now = self.closed(following)
        return best


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template; ValueError for markup that doesn't balance or leaves no mandatory word."""
    auto = Automaton(label)
    here, opened, mandatory, last = auto.state(), [], 0, 0

    def wording(text: str) -> None:
        nonlocal here, mandatory
        for w in _WORD.findall(text.translate(_LOW)):
            there = auto.state()
            auto.words[here].setdefault(w.encode(), set()).add(there)
            here = there
            mandatory += not opened

    for m in _MARKUP.finditer(template):
        wording(template[last : m.start()])
        last = m.end()
        if m.group() == "[[":
            opened.append(here)
        elif m.group() == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            before, there = opened.pop(), auto.state()
            auto.skip[here].add(there)
            auto.skip[before].add(there)
            here = there
        else:
            ends = [here]
            for _ in range(int(m.group(1))):
                there = auto.state()
                auto.any[here].add(there)
                here = there
                ends.append(here)
            there = auto.state()
            for s in ends:
                auto.skip[s].add(there)
            here = there
    wording(template[last:])
    if opened or not mandatory:
        raise ValueError(f"{label}: unbalanced markup or no mandatory wording")
    auto.final = here
    return auto


class LicenseMatcher:
    """All templates and base phrases, indexed by the words that can begin them."""

    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[tuple[str, ...], str] | None = None):
        self.phrases = {tuple(w.encode() for w in p): x for p, x in (PHRASES if phrases is None else phrases).items()}
        autos = [compile_template(label, t) for label, many in (TEMPLATES | OPENINGS if templates is None else templates).items() for t in many]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in autos:
            for w in a.firsts():
                self.by_first.setdefault(w, []).append(a)
        # A word that every match of some automaton must hold; texts without any of them are passed over.
        self.needed = {p[-1] for p in self.phrases} | {_rarest(a) for a in autos}
        self.starts = set(self.by_first) | {p[0] for p in self.phrases}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Places (label, first word, end word) of the base phrases and of the accepted templates."""
        base, found = [], []
        if self.needed.isdisjoint(words):
            return base, found
        starts = self.starts
        for i, w in enumerate(words):
            if w not in starts:
                continue
            for p, label in self.phrases.items():
                if w == p[0] and tuple(words[i : i + len(p)]) == p:
                    base.append((label, i, i + len(p)))
            for a in self.by_first.get(w, ()):
                if (end := a.match(words, i)) >= 0:
                    found.append((a.label, i, end))
        # An opening is told only where its license isn't.
        whole = {(label, i) for label, i, _ in found}
        return base, [x for x in found if not any((label, x[1]) in whole for label in _OF_OPENING.get(x[0], ()))]


def _mandatory(a: Automaton) -> set[bytes]:
    """Words on every path of an automaton: those whose removal cuts its start from its end."""
    out = set()
    for w in {w for edges in a.words for w in edges}:
        reached, todo = {0}, [0]
        while todo:
            s = todo.pop()
            for t in (*(t for x, ts in a.words[s].items() if x != w for t in ts), *a.any[s], *a.skip[s]):
                if t not in reached:
                    reached.add(t)
                    todo.append(t)
        if a.final not in reached:
            out.add(w)
    return out


_COMMON = {b"the", b"a", b"to", b"of", b"is", b"in", b"under", b"this", b"all", b"for", b"and", b"by", b"any", b"1", b"2", b"3", b"use", b"or", b"version"}


def _rarest(a: Automaton) -> bytes:
    """The longest mandatory word that isn't an everyday one."""
    words = _mandatory(a)
    return max(words - _COMMON or words, key=lambda w: (len(w), w))


def scan_licenses(
    df: DataFrame,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    phrases: dict[tuple[str, ...], str] | None = None,
) -> DataFrame:
    """`id_cols` of each row, its number of words, and the places of license wording in its whole text.

    `base` and `matches` are arrays of (kind, start, end) in words from 0, end exclusive: base phrases, and
    templates whose mandatory wording matches exactly. `score` is 1 where a license's template is accepted, 0.75 where only a
    base phrase stands, 0.5 where only a license's opening clause does, else 0. Null and empty texts have no words and no places. Overlapping places of different
    templates are all reported, ties in template order. Repeated rows repeat; other columns are not read.
    """

    def start():
        matcher = LicenseMatcher(templates, phrases)

        def work(texts):
            out = {"n_words": [], "base": [], "matches": [], "score": []}
            for t in texts:
                words = words_of(t or b"")
                base, found = matcher.scan(words)
                out["n_words"].append(len(words))
                for name, places in (("base", base), ("matches", found)):
                    out[name].append([{"kind": k, "start": a, "end": b} for k, a, b in places])
                out["score"].append(1.0 if any(x[0] not in OPENINGS for x in found) else 0.75 if base else 0.5 if found else 0.0)
            return out

        return work

    from .common import SPAN

    new = T.StructType([field("n_words", T.LongType()), field("base", T.ArrayType(SPAN)), field("matches", T.ArrayType(SPAN)), field("score", T.DoubleType())])
    return map_texts(df, id_cols or ["doc_id"], text_col, new, start)
