"""Licence scan: templates with optional and replaceable regions, compiled into token automata.

A text is its words: runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased. A
template is wording with markup:

``<<beginOptional>> … <<endOptional>>``   wording that may be left out; may be nested
``<<var;name="holder";words="0-30">>``    so many words of any kind, for names, years and addresses

Everything else is mandatory and has to stand there word by word; case and punctuation do not count,
as they are not part of a word. All templates form one automaton over words, made deterministic as
far as texts need it. It is started at every word a template begins with and stopped as soon as no
template can follow, so wording is found anywhere in a whole text. Per template and starting word the
longest accepted stretch is reported.

Base phrases are templates without markup; their places are counted apart.

Defined results: a null or wordless text has no words, no places, empty label lists and a score of 0. The
score is the highest confidence of a template found (PHRASE, NOTICE or FULL). Rows are judged one by
one, so repeated rows and ids, and further columns, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of a name only, of a notice or reference, and of a whole licence text.
PHRASE, NOTICE, FULL = 0.5, 0.8, 1.0

#: States a worker keeps of the deterministic automaton; it starts anew beyond them.
MAX_STATES = 200_000


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    confidence: float = NOTICE


# Phrases and labels of the contract.
BASE_PHRASES = (
    Template("mit-phrase", "mit", "mit license", PHRASE),
    Template("apache-phrase", "apache", "apache license", PHRASE),
    Template("gpl-phrase", "gpl", "general public license", PHRASE),
)

# Wording of public licences, their notices, and how they are referred to.
TEMPLATES = (
    Template(
        "mit-text", "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial "
        "portions of the Software.",
        FULL,
    ),
    Template("mit-reference", "mit", "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    Template("mit-licensed", "mit", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>license<<endOptional>>"),
    Template("mit-spdx", "mit", "SPDX License Identifier: MIT"),
    Template(
        "isc-text", "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        FULL,
    ),
    Template("isc-spdx", "isc", "SPDX License Identifier: ISC"),
    Template(
        "bsd-text", "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: <<var;name=\"bullet\";words=\"0-1\">> Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer",
        FULL,
    ),
    Template("bsd-reference", "bsd", '<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the<<endOptional>> <<var;name="clauses";words="0-3">> BSD <<beginOptional>>style<<endOptional>> license'),
    Template("bsd-spdx", "bsd", 'SPDX License Identifier: BSD'),
    Template(
        "apache-notice", "apache",
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>; you may not use this "
        "<<var;name=\"work\";words=\"1-3\">> except in compliance with the License",
        FULL,
    ),
    Template("apache-reference", "apache", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>software<<endOptional>> License <<beginOptional>>version<<endOptional>> <<beginOptional>>2 <<beginOptional>>0<<endOptional>><<endOptional>>"),
    Template("apache-spdx", "apache", "SPDX License Identifier: Apache 2.0"),
    Template(
        "gpl-notice", "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation",
        FULL,
    ),
    Template("gpl-reference", "gpl", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>General Public License<<endOptional>> <<beginOptional>>GPL<<endOptional>> <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 3"),
    Template("gpl-spdx", "gpl", 'SPDX License Identifier: GPL'),
    Template(
        "lgpl-notice", "lgpl",
        "under the terms of the GNU <<var;name=\"kind\";words=\"1-1\">> General Public License",
    ),
    Template("mpl-notice", "mpl", "subject to the terms of the Mozilla Public License <<beginOptional>>v. 2.0<<endOptional>>", FULL),
    Template("mpl-reference", "mpl", "licensed under <<beginOptional>>the<<endOptional>> Mozilla Public License"),
    Template("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain", FULL),
    Template("cc-by-nc-reference", "cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY NC <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>>"),
    Template("cc-by-nc-name", "cc-by-nc", "Creative Commons Attribution NonCommercial"),
    Template("cc-by-nc-hyphened", "cc-by-nc", "Creative Commons Attribution Non Commercial"),
    Template("cc-by-reference", "cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>> <<beginOptional>>version<<endOptional>> 4 0"),
    Template("cc-by-name", "cc-by", "under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<beginOptional>>ShareAlike<<endOptional>> <<beginOptional>>4 0 <<beginOptional>>International<<endOptional>><<endOptional>> License"),
    Template("cc0-reference", "cc0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    Template("proprietary-notice", "proprietary", 'Copyright <<var;name="holder";words="0-12">> All rights reserved', NOTICE),
)

RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "places array<struct<template:string,label:string,first_word:long,n_words:long,start:long,end:long>>"
)
_PLACE = pa.struct(
    [
        ("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()),
        ("start", pa.int64()), ("end", pa.int64()),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(_PLACE)),
    ]
)

_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
_RANGE = re.compile(r'words="(\d+)-(\d+)"')


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def parse(template: str) -> list:
    """Wording as a list of words, ``(least, most)`` replaceable regions and lists for optional regions."""
    open_lists: list[list] = [[]]
    for at, piece in enumerate(_MARKUP.split(template)):
        if at % 2 == 0:
            open_lists[-1] += words_of(piece)
        elif piece == "beginOptional":
            open_lists.append([])
        elif piece == "endOptional":
            if len(open_lists) == 1:
                raise ValueError("endOptional without beginOptional")
            region = open_lists.pop()
            open_lists[-1].append(region)
        else:
            bounds = _RANGE.search(piece)
            if bounds is None or int(bounds[1]) > int(bounds[2]):
                raise ValueError(f"a replaceable region needs words=\"least-most\": {piece}")
            open_lists[-1].append((int(bounds[1]), int(bounds[2])))
    if len(open_lists) > 1:
        raise ValueError("beginOptional without endOptional")
    return open_lists[0]


class Automaton:
    """All templates as one automaton over words; deterministic states are made when first met."""

    ANY = -1

    def __init__(self, templates: Sequence[Template]) -> None:
        self.templates = tuple(templates)
        self.classes: dict[bytes, int] = {}
        self.moves: list[list[tuple[int, int]]] = [[]]  # per state: (word class or ANY, next state)
        self.free: list[list[int]] = [[]]  # per state: states reached without a word
        self.accepts: dict[int, int] = {}
        for number, template in enumerate(templates):
            parsed = parse(template.text)
            if not any(isinstance(item, bytes) for item in parsed) or isinstance(parsed[0], tuple) or isinstance(parsed[-1], tuple):
                raise ValueError(f"{template.name}: mandatory words are needed, and none but words at the ends")
            start = self._state()
            self.free[0].append(start)
            self.accepts[self._sequence(parsed, start)] = number
        self._forget()
        first = self.sets[0]
        if any(wanted == self.ANY for state in first for wanted, _ in self.moves[state]):
            raise ValueError("a template may not begin with any word")
        self.starters = np.zeros(len(self.classes) + 1, bool)
        self.starters[[wanted for state in first for wanted, _ in self.moves[state]]] = True

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _step(self, state: int, wanted: int) -> int:
        following = self._state()
        self.moves[state].append((wanted, following))
        return following

    def _sequence(self, items: list, state: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                state = self._step(state, self.classes.setdefault(item, len(self.classes) + 1))
            elif isinstance(item, tuple):
                least, most = item
                skips = []
                for count in range(most):
                    if count >= least:
                        skips.append(state)
                    state = self._step(state, self.ANY)
                for skip in skips:
                    self.free[skip].append(state)
            else:
                end = self._sequence(item, state)
                joined = self._state()
                self.free[end].append(joined)
                self.free[state].append(joined)
                state = joined
        return state

    def _forget(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.numbers: dict[frozenset[int], int] = {}
        self.found: list[tuple[int, ...]] = []
        self.table: dict[tuple[int, int], int] = {}
        self._number(self._closed({0}))

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        reached, waiting = set(states), list(states)
        while waiting:
            for following in self.free[waiting.pop()]:
                if following not in reached:
                    reached.add(following)
                    waiting.append(following)
        return frozenset(reached)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.found.append(tuple(sorted(self.accepts[s] for s in states if s in self.accepts)))
        return self.numbers[states]

    def _next(self, state: int, word: int) -> int:
        """The state after a word, -1 where no template goes on."""
        reached = {to for at in self.sets[state] for wanted, to in self.moves[at] if wanted in (word, self.ANY)}
        following = self._number(self._closed(reached)) if reached else -1
        self.table[state, word] = following
        return following

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, number of words) of every accepted stretch, the longest per start."""
        known = self.classes.get
        classes = [known(word, 0) for word in words]
        starts = np.flatnonzero(self.starters[classes]) if classes else []
        if len(self.sets) > MAX_STATES:
            self._forget()
        out, table, total = [], self.table, len(classes)
        for start in map(int, starts):
            state, at, longest = 0, start, {}
            while at < total:
                word = classes[at]
                following = table.get((state, word))
                state = self._next(state, word) if following is None else following
                if state < 0:
                    break
                at += 1
                for template in self.found[state]:
                    longest[template] = at - start
            out += [(template, start, size) for template, size in sorted(longest.items())]
        return out


def judge(text: str | None, automaton: Automaton, n_phrases: int) -> dict:
    """One RESULT; the first ``n_phrases`` templates of the automaton are the base phrases."""
    words = words_of(text)
    found = automaton.places(words)
    base = [start for template, start, _ in found if template < n_phrases]
    spans = [match.span() for match in _ORIGINAL_WORD.finditer(text)] if found else []
    named = [automaton.templates[template] for template, _, _ in found]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted({t.label for t, (template, _, _) in zip(named, found) if template < n_phrases})),
        "labels": ",".join(sorted({t.label for t in named})),
        "score": max((t.confidence for t in named), default=0.0),
        "places": [
            {
                "template": t.name, "label": t.label, "first_word": first, "n_words": size,
                "start": spans[first][0], "end": spans[first + size - 1][1],
            }
            for t, (_, first, size) in zip(named, found)
        ],
    }


_compiled: dict[tuple, Automaton] = {}


def compiled(templates: tuple[Template, ...]) -> Automaton:
    """The automaton of a worker process, built once for all its batches."""
    if templates not in _compiled:
        _compiled.clear()
        _compiled[templates] = Automaton(templates)
    return _compiled[templates]


def scan(
    text: Column, phrases: Sequence[Template] = BASE_PHRASES, templates: Sequence[Template] = TEMPLATES
) -> Column:
    """A RESULT struct for each text: words, base places, labels, score, and all places in words and code points."""
    every, n_phrases = (*phrases, *templates), len(phrases)
    Automaton(every)  # a faulty template is refused here, not in a task

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        automaton = compiled(every)
        return pa.array([judge(text.as_py(), automaton, n_phrases) for text in texts], _ARROW)

    return scanned(text)
