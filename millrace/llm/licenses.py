"""License scans by matching marked-up templates.

A template is a line of mandatory words with optional regions in double square
brackets and replaceable regions in double braces, as in

    this work is licensed under the [[gnu]] general public license [[version {{2}}]]

where ``{{2}}`` stands for one or two words of any kind. Regions may nest. All
templates compile to one automaton over words, in which templates that begin
alike share states; a text is accepted at a place if its words from there on
meet every mandatory word exactly, in order, however long the wording. Scans
hash all words of a batch at once and look only at places where a template's
first two mandatory words stand, so ordinary prose costs a few array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.shared import id_and_text
from millrace.llm.shingles import LOWER, WORD_BYTES, text_slices, word_hashes, words

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The wording of public licences, in lower case and without punctuation.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
_MIT = f"{_MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{9}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC_DISCLAIMER = "the software is provided as is and {{9}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by {{9}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "[[in no event shall {{9}} be liable for any direct indirect incidental special exemplary or consequential damages]]"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{1}} www apache org licenses license 2 0 "
    "[[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "[[see the license for the specific language governing permissions and limitations under the license]]]]"
)
_CC_FREEDOMS = "share copy and redistribute the material in any medium or format [[for any purpose even commercially]] adapt remix transform and build upon the material for any purpose even commercially"
_CC_MANNER = "you may do so in any reasonable manner but not in any way that suggests the licensor endorses you or your use"


def _gnu(kind: str, version: str) -> str:
    """The notice of a GNU licence: ``kind`` stands before "public license"."""
    return (
        f"free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation [[either]] version {version} of the license "
        "[[or at your option any later version]] [[{{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        f"[[see the gnu {kind} public license for more details [[you should have received a copy of the gnu {kind} public license along with {{{{4}}}}]]]]]]"
    )


#: Templates: label and wording. The first two words must be mandatory.
TEMPLATES = (
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
    ("cc-by-any", "licensed under cc by [[nc]] [[sa]] [[nd]] {{2}}"),
    ("cc-by-any", "work is licensed under a creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{2}} [[international]] license"),
    ("gpl-3.0", "licensed under the [[terms of the]] [[gnu]] general public license version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] [[gnu]] general public license version 2"),
    ("gpl-any", "under the terms of the gnu general public license as published by the free software foundation [[either]] version {{1}} [[of the license]]"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("reserved-notice", "copyright c {{8}} all rights reserved"),
    ("reserved-notice", "all rights reserved [[by {{4}}]]"),
    ("mit-text", f"{_MIT} [[{_MIT_DISCLAIMER}]]"),
    ("mit-text-no-attribution", f"{_MIT_GRANT} [[{_MIT_DISCLAIMER}]]"),
    ("isc-text", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [[provided that the above copyright notice and this permission notice appear in all copies]] [[{_ISC_DISCLAIMER}]]"),
    ("bsd-2-clause", f"{_BSD} [[{_BSD_DISCLAIMER}]]"),
    ("bsd-3-clause", f"{_BSD} [[3]] neither the name of {{{{9}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[{_BSD_DISCLAIMER}]]"),
    ("apache-2.0-notice", _APACHE),
    ("gpl-2.0-notice", _gnu("general", "2")),
    ("gpl-3.0-notice", _gnu("general", "3")),
    ("lgpl-2.1-notice", _gnu("lesser general", "2 1")),
    ("lgpl-3.0-notice", _gnu("lesser general", "3")),
    ("agpl-3.0-notice", _gnu("affero general", "3")),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{1}} mozilla org mpl 2 0"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-notice", "to the extent possible under law {{9}} [[has]] [[have]] waived all copyright and related or neighboring rights to {{9}}"),
    ("cc-by-4.0-deed", f"you are free to {_CC_FREEDOMS} under the following terms attribution you must give appropriate credit provide a link to the license and indicate if changes were made [[{_CC_MANNER}]] no additional restrictions"),
    ("cc-by-sa-4.0-deed", f"you are free to {_CC_FREEDOMS} under the following terms attribution you must give appropriate credit provide a link to the license and indicate if changes were made [[{_CC_MANNER}]] sharealike if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-work-notice", "this work is licensed under [[a]] [[the]] creative commons {{6}} [[{{2}} [[international]] [[unported]]]] license [[to view a copy of this license visit {{1}} creativecommons org licenses {{6}}]]"),
)

_TOKEN = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[a-z0-9]+")


@dataclass
class Automaton:
    """``steps``: next states by word, None for any word; ``skips``: states reached without a word; ``final``: labels of the states where templates end.

    ``trunk`` holds the states that only one sequence of mandatory words reaches; templates share them.
    """

    steps: list[dict[str | None, list[int]]] = field(default_factory=lambda: [{}])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    final: dict[int, set[str]] = field(default_factory=dict)
    trunk: set[int] = field(default_factory=lambda: {0})
    anchors: set[tuple[str, str]] = field(default_factory=set)

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        own = cls()
        own.add(label, template)
        return own

    def _step(self, at: int, word: str | None, alone: bool) -> int:
        if alone:
            for known in self.steps[at].get(word, ()):
                if known in self.trunk:
                    return known
        self.steps.append({})
        self.skips.append([])
        new = len(self.steps) - 1
        self.steps[at].setdefault(word, []).append(new)
        if alone:
            self.trunk.add(new)
        return new

    def add(self, label: str, template: str) -> None:
        at, opened, leading, alone = 0, [], [], True
        for token in _TOKEN.finditer(template):
            if token.group() == "[[":
                if len(leading) < 2:
                    raise ValueError(f"{label}: a template starts with two mandatory words")
                # A region begins and ends in states of its own: a state of the trunk may have steps of other templates.
                if alone:
                    alone, at = False, self._beside(at)
                opened.append(at)
            elif token.group() == "]]":
                self.skips[opened.pop()].append(at)
            elif token.group(1):
                if len(leading) < 2:
                    raise ValueError(f"{label}: a template starts with two mandatory words")
                alone = False
                states = [at]
                for _ in range(int(token.group(1))):
                    states.append(self._step(states[-1], None, False))
                at = states[-1]
                for state in states[1:-1]:
                    self.skips[state].append(at)
            else:
                at = self._step(at, token.group(), alone)
                if len(leading) < 2:
                    leading.append(token.group())
        if opened or len(leading) < 2:
            raise ValueError(f"{label}: unbalanced regions or no two leading words")
        self.final.setdefault(at, set()).add(label)
        self.anchors.add((leading[0], leading[1]))

    def _beside(self, at: int) -> int:
        self.steps.append({})
        self.skips.append([])
        self.skips[at].append(len(self.steps) - 1)
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def found(self, words: Iterable[str]) -> dict[str, int]:
        """The templates that accept a beginning of ``words``, each with the words of the longest; words are read as far as any template goes on."""
        states, longest = self._closed({0}), {}
        for k, word in enumerate(words, 1):
            states = self._closed({t for s in states for w in (word, None) for t in self.steps[s].get(w, ())})
            if not states:
                break
            for s in states:
                for label in self.final.get(s, ()):
                    longest[label] = k
        return longest

    def accepts(self, text: list[str], at: int) -> int:
        """Words of the longest match from ``at`` on, 0 if there is none."""
        return max(self.found(text[at:]).values(), default=0)


def compiled(templates: Iterable[tuple[str, str]]) -> Automaton:
    """One automaton for all templates."""
    out = Automaton()
    for label, template in templates:
        out.add(label, template)
    return out


#: Each template alone, and all together.
AUTOMATA = tuple(Automaton.compile(*t) for t in TEMPLATES)
ALL = compiled(TEMPLATES)


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _places(hashes: np.ndarray, text: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Words at which ``phrase`` stands within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(hashes[:n] == np.uint64(phrase[0]))
    for k, h in enumerate(phrase[1:], 1):
        at = at[hashes[at + k] == np.uint64(h)]
    return at[text[at] == text[at + len(phrase) - 1]]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = {label: [_hash(w) for w in phrase.split()] for phrase, label in PHRASES.items()}
    hashed = [[_hash(w) for w in pair] for pair in sorted(ALL.anchors)]
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column("text")):
            low, texts = LOWER[raw], end - first
            start, stop, before = words(low, offsets, WORD_BYTES)
            hashes = word_hashes(low, start, stop)
            text = np.repeat(np.arange(texts), np.diff(before))
            base: list[set[str]] = [set() for _ in range(texts)]
            found: list[list[tuple[str, int, int]]] = [[] for _ in range(texts)]
            count, least, most = np.zeros(texts, np.int64), np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
            for label, phrase in phrases.items():
                at = _places(hashes, text, phrase)
                own = text[at]
                np.add.at(count, own, 1)
                np.minimum.at(least, own, at - before[own])
                np.maximum.at(most, own, at - before[own])
                for t in set(own.tolist()):
                    base[t].add(label)
            for pair in hashed:
                for at in _places(hashes, text, pair).tolist():
                    t = int(text[at])
                    rest = (low[start[k] : stop[k]].tobytes().decode("utf-8", "replace") for k in range(at, int(before[t + 1])))
                    found[t] += [(label, at - int(before[t]), n) for label, n in ALL.found(rest).items()]
            labels = [sorted(b | {f[0] for f in own}) for b, own in zip(base, found)]
            hit = count > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, texts),
                    pa.array(np.diff(before).astype(np.int64)),
                    pa.array(count),
                    pa.array(least, mask=~hit),
                    pa.array(most, mask=~hit),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()),
                    pa.array([",".join(x) for x in labels], pa.string()),
                    pa.array([1.0 if own else 0.5 if b else 0.0 for b, own in zip(base, found)]),
                    pa.array([",".join(f"{name}:{at}:{n}" for name, at, n in sorted(set(own), key=lambda f: (f[1], f[0], f[2]))) for own in found], pa.string()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


def scan(docs: DataFrame) -> DataFrame:
    """License wording of every row of ``docs`` (doc_id, text), columns as in ``SCHEMA``.

    Words are runs of ASCII letters, digits and anything outside ASCII, with A-Z lower-cased.
    ``n_base`` counts the places of all base phrases, ``first_word`` and ``last_word`` are the least
    and greatest of their starts (null without any). ``labels`` adds the labels of accepted templates;
    ``matches`` lists them as label:first word:words. ``score`` is 1 if a template is accepted, 0.5 for
    base phrases alone, else 0. Null and empty texts have no words and score 0. Rows that repeat and
    null doc_ids get rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    return id_and_text(docs).mapInArrow(_scanned, SCHEMA)


def _expression(template: str) -> str:
    """A template as a regular expression over words that each stand between two blanks."""
    out = []
    for token in _TOKEN.finditer(template):
        if token.group() == "[[":
            out.append("(")
        elif token.group() == "]]":
            out.append(")?")
        elif token.group(1):
            out.append(f"( [^ ]+ ){{1,{token.group(1)}}}")
        else:
            out.append(f" {token.group()} ")
    return "".join(out)


def _places_sql(phrase: str) -> str:
    tests = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {tests})"


def _oracle() -> str:
    by_label: dict[str, list[str]] = {}
    for label, template in TEMPLATES:
        by_label.setdefault(label, []).append(_expression(template))
    own = ", ".join(f"CASE WHEN regexp_matches(s, '{'|'.join(f'({e})' for e in expressions)}') THEN '{label}' END" for label, expressions in by_label.items())
    phrases = {label: f"p{k}" for k, label in enumerate(PHRASES.values())}
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in phrases.items())
    every = " || ".join(phrases.values())
    return rf"""
        WITH split AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        placed AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS s, {", ".join(f"{_places_sql(phrase)} AS {phrases[label]}" for phrase, label in PHRASES.items())} FROM split),
        named AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{own}], lambda x: x IS NOT NULL) AS m, {every} AS places FROM placed)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT - 1 AS first_word, list_max(places)::BIGINT - 1 AS last_word,
               array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_distinct(b || m)), ',') AS labels,
               CASE WHEN len(m) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM named"""


ORACLE_SQL = _oracle()
