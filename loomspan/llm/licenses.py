"""License scans (operator 13): template-markup matching.

A template is the wording of a license or notice in a small markup: ``[[ ... ]]`` is an optional region (nesting is allowed),
``<name:a-b>`` a replaceable region of a to b words of any kind, everything else is mandatory.  Every template is compiled to
an automaton without empty moves whose states are its words; a replaceable region is a chain of states that take any
word.  All automata run side by side: origins are the words that may begin a template, and one step moves all origins of a
piece of text by one word, so mandatory wording must match exactly, word for word, with nothing left out or put between.
Of the places at which a template accepts from one origin the longest counts.  Case, punctuation and line breaks do not.

Base phrases are found wherever their words stand consecutively.

Cases: a null text is the empty one, without words, labels or places and with score 0; repeated rows are scanned each for
itself; places may overlap; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

# The phrases of the contract and the public wording of licenses and of their usual notices.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
_DISCLAIMER = """this software is provided by <owner:1-12> as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <owner:1-12> be
liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and
the following disclaimer in the documentation and or other materials provided with the distribution"""
_GNU = """this [[program]] [[library]] [[file]] is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free
software foundation either version {1} of the license or at your option any later version [[this [[program]] [[library]] [[file]] is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
purpose see the gnu {0} for more details]]"""
TEMPLATES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
     files the software to deal in the software without restriction including without limitation the rights to use copy modify
     merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
     furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the
     next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is
     without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
     particular purpose and noninfringement in no event shall <owner:1-12> be liable for any claim damages or other
     liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the
     use or other dealings in the software"""),
    ("mit", "[[this [[<name:1-3>]] is]] [[released]] [[licensed]] [[distributed]] [[available]] under the [[terms of the]] mit license"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
     provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
     <owner:1-12> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
     in no event shall <owner:1-12> be liable for any special direct indirect or consequential damages or any damages whatsoever
     resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out
     of or in connection with the use or performance of this software"""),
    ("bsd-2-clause", f"{_BSD} {_DISCLAIMER}"),
    ("bsd-3-clause", f"""{_BSD} [[3]] neither the name of <owner:1-12> nor the names of its contributors may be used to endorse or promote products
     derived from this software without specific prior written permission {_DISCLAIMER}"""),
    ("apache-2.0", """licensed under the apache license version 2 0 [[the license [[you]] may not use this [[file]] [[work]] except in compliance with the license
     you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
     to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
     any kind either express or implied see the license for the specific language governing permissions and limitations under the
     license]]"""),
    ("gpl-2.0-or-later", _GNU.format("general public license", "2")),
    ("gpl-3.0-or-later", _GNU.format("general public license", "3")),
    ("lgpl-2.1-or-later", _GNU.format("lesser general public license", "2 1")),
    ("lgpl-3.0-or-later", _GNU.format("lesser general public license", "3")),
    ("agpl-3.0-or-later", _GNU.format("affero general public license", "3")),
    ("gpl-2.0", "[[this [[<name:1-3>]] is]] licensed under the [[terms of the]] gnu general public license version 2 [[0]] [[only]]"),
    ("gpl-3.0", "[[this [[<name:1-3>]] is]] licensed under the [[terms of the]] gnu general public license version 3 [[0]] [[only]]"),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
     file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
     damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
     commercial applications and to alter it and redistribute it freely subject to the following restrictions"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
     sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or
     non commercial and by any means"""),
    *((f"cc-{k}-{v}", f"licensed under [[a]] [[the]] cc {k.replace('-', ' ')} {v.replace('.', ' ')} [[license]] [[licence]]") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")),
    *((f"cc-{k}-{v}", f"licensed under [[a]] [[the]] creative commons {long} {v.replace('.', ' ')} [[international]] [[unported]] license") for k, long in (
        ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"),
        ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")) for v in ("3.0", "4.0")),
    *((k, f"spdx license identifier {k.replace('-', ' ').replace('.', ' ')}") for k in ("mit", "isc", "zlib", "apache-2.0", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "cc0-1.0")),
]

_ANY, _NONE = -2, -1
_MARK = re.compile(r"\[\[|\]\]|<([^<>:]*):(\d+)-(\d+)>|[^\s\[\]<>]+")


class _Part(NamedTuple):
    """A stretch of a template: may it be skipped, and its first and last states."""

    empty: bool
    first: frozenset[int]
    last: frozenset[int]


_NOTHING = _Part(True, frozenset(), frozenset())


class Automata(NamedTuple):
    """States of all templates: the code of the word each takes, its template, whether it may begin or accept, and its followers
    (state s has ``follow[at[s] : at[s + 1]]``)."""

    words: list[str]
    code: np.ndarray
    template: np.ndarray
    begins: np.ndarray
    accepts: np.ndarray
    at: np.ndarray
    follow: np.ndarray
    labels: list[str]
    phrases: list[tuple[list[int], str]]


def compile_templates(templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES)) -> Automata:
    """Automata of (label, markup) templates and the words of (phrase, label) pairs.  A template must begin with a word, optional or
    not, and have a mandatory one."""
    known: dict[str, int] = {}
    code: list[int] = []
    follow: list[set[int]] = []
    template, begins, accepts = [], [], []

    def state(c: int, t: int) -> _Part:
        code.append(c)
        template.append(t)
        follow.append(set())
        one = frozenset([len(code) - 1])
        return _Part(False, one, one)

    def after(a: _Part, b: _Part) -> _Part:
        for s in a.last:
            follow[s] |= b.first
        return _Part(a.empty and b.empty, a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last)

    for t, (_, markup) in enumerate(templates):
        open_: list[_Part] = [_NOTHING]
        for m in _MARK.finditer(markup):
            if m[0] == "[[":
                open_.append(_NOTHING)
            elif m[0] == "]]":
                inner = open_.pop()
                open_[-1] = after(open_[-1], inner._replace(empty=True))
            elif m[2]:
                region = _NOTHING  # from its end: words that may be missing, before them those that may not
                for i in range(int(m[3])):
                    region = after(state(_ANY, t), region)._replace(empty=i < int(m[3]) - int(m[2]))
                open_[-1] = after(open_[-1], region)
            else:
                for w in _words(m[0]):
                    open_[-1] = after(open_[-1], state(known.setdefault(w, len(known)), t))
        if len(open_) != 1 or open_[0].empty or any(code[s] == _ANY for s in open_[0].first):
            raise ValueError(f"template {t}: unbalanced markup, nothing mandatory, or no word at its start")
        begins += open_[0].first
        accepts += open_[0].last
    coded = [([known.setdefault(w, len(known)) for w in _words(p)], label) for p, label in phrases]
    mask = lambda states: np.isin(np.arange(len(code)), states)
    sizes = [len(f) for f in follow]
    return Automata(list(known), np.array(code, np.int64), np.array(template, np.int64), mask(begins), mask(accepts), np.cumsum([0, *sizes]), np.array([x for f in follow for x in sorted(f)], np.int64), [x for x, _ in templates], coded)


def _words(text: str) -> list[str]:
    buf, offsets = textops.buffers(pa.array([text], pa.string()))
    return textops.strings(textops.find_words(textops.LOWER[buf], offsets, _WORD)).to_pylist()


def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For CSR offsets: (index into ``rows``, position in the values) of every value of every row."""
    n = at[rows + 1] - at[rows]
    return np.repeat(np.arange(len(rows)), n), np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


def template_places(auto: Automata, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, first word, end) of the longest match of every template from every word; ``ends`` is where the text of each word ends."""
    first = np.flatnonzero(auto.begins)
    first = first[np.argsort(auto.code[first], kind="stable")]
    by_code = np.searchsorted(auto.code[first], np.arange(len(auto.words) + 1))
    here = np.flatnonzero(codes >= 0)
    i, j = _spread(by_code, codes[here])
    origin, state, step, found = here[i], first[j], 1, []
    states = len(auto.code)
    while len(origin):
        done = auto.accepts[state]
        found.append(np.stack([auto.template[state[done]], origin[done], origin[done] + step]))
        i, j = _spread(auto.at, state)
        origin, state = origin[i], auto.follow[j]
        ok = origin + step < ends[origin]
        origin, state = origin[ok], state[ok]
        ok = (auto.code[state] == _ANY) | (auto.code[state] == codes[origin + step])
        key = np.unique(origin[ok] * states + state[ok])
        origin, state = np.divmod(key, states)
        step += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    t, a, b = np.concatenate(found, 1)
    order = np.lexsort((b, a, t))
    t, a, b = t[order], a[order], b[order]
    longest = np.append((np.diff(t) != 0) | (np.diff(a) != 0), True)[: len(t)]
    return t[longest], a[longest], b[longest]


def phrase_places(auto: Automata, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, np.ndarray, int]]:
    """(label, first words, length) of every base phrase."""
    for phrase, label in auto.phrases:
        at = np.flatnonzero(codes == phrase[0])
        at = at[at + len(phrase) <= ends[at]]
        for i, c in enumerate(phrase[1:], 1):
            at = at[codes[at + i] == c]
        yield label, at, len(phrase)


class Scan(NamedTuple):
    """Places of a run of texts: text, kind (0 base, 1 template), label, first word and end within the text; words of each text."""

    text: np.ndarray
    kind: np.ndarray
    label: list[str]
    first: np.ndarray
    end: np.ndarray
    n_words: np.ndarray


def scan(auto: Automata, column: pa.Array) -> Scan:
    """All places in all texts of a column."""
    parts, labels, counts, vocabulary = [np.zeros((4, 0), np.int64)], [], [np.zeros(0, np.int64)], pa.array(auto.words, pa.large_string())
    for row, _, buf, offsets in textops.slices(column):
        words = textops.find_words(textops.LOWER[buf], offsets, _WORD)
        n = np.diff(words.first)
        counts.append(n)
        codes = pc.index_in(textops.strings(words), vocabulary).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.repeat(words.first[1:], n)
        text = np.repeat(np.arange(len(n)), n)
        for label, at, size in phrase_places(auto, codes, ends):
            labels += [label] * len(at)
            parts.append(np.stack([row + text[at], np.zeros(len(at), np.int64), at - words.first[text[at]], at + size - words.first[text[at]]]))
        t, a, b = template_places(auto, codes, ends)
        labels += [auto.labels[i] for i in t]
        parts.append(np.stack([row + text[a], np.ones(len(a), np.int64), a - words.first[text[a]], b - words.first[text[a]]]))
    text, kind, first, end = np.concatenate(parts, 1)
    return Scan(text, kind, labels, first, end, np.concatenate(counts))


def covered(first: np.ndarray, end: np.ndarray) -> int:
    """Words within at least one of the places."""
    order = np.argsort(first, kind="stable")
    reach = np.maximum.accumulate(np.append(0, end[order]))
    return int(np.maximum(0, end[order] - np.maximum(first[order], reach[:-1])).sum())


def license_places(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place: doc_id, kind (base or template), label, first_word, end_word (exclusive)."""
    auto = compile_templates(templates, phrases)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scan(auto, b.column("text"))
            kinds = pa.array(np.where(s.kind == 0, "base", "template"), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(s.text)), kinds, pa.array(s.label, pa.string()), pa.array(s.first), pa.array(s.end)], names=["doc_id", "kind", "label", "first_word", "end_word"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, kind string, label string, first_word long, end_word long")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word (of base places), base_labels, labels, n_templates, score.

    ``score`` is the share of the document's words that lie in a place of either kind.
    """
    auto = compile_templates(templates, phrases)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, size = scan(auto, b.column("text")), b.num_rows
            base = s.kind == 0
            n_base = np.bincount(s.text[base], minlength=size)
            low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
            np.minimum.at(low, s.text[base], s.first[base])
            np.maximum.at(high, s.text[base], s.first[base])
            base_labels, labels, score = [""] * size, [""] * size, np.zeros(size)
            order = np.argsort(s.text, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(s.text[order])) + 1) if len(order) else ():
                i = s.text[group[0]]
                base_labels[i] = ",".join(sorted({s.label[g] for g in group if base[g]}))
                labels[i] = ",".join(sorted({s.label[g] for g in group}))
                score[i] = covered(s.first[group], s.end[group]) / s.n_words[i]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s.n_words), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(base_labels), pa.array(labels), pa.array(np.bincount(s.text[~base], minlength=size)), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_templates", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_templates long, score double")
