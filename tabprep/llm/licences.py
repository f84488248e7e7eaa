"""Licence scan: matching statistics of every text against a suffix automaton of all licence templates, then chaining.

Each text is streamed once through the automaton; at every word that gives the longest run of words ending there which
stands in some template. Long runs are chained into spans that cover a template in order, with small gaps. The base
phrases are strings of the same automaton, found where the current run ends with the whole phrase.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import ascii_lower, filled, long_id, pick, stream, table

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices by label. A label may have several templates.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software.",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",),
}

MIN_RUN = 4  # words of a match worth chaining
MAX_GAP = 8  # words between two matches of a span, in the text and in the template
MIN_COVER = 0.75  # of a template's words

_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_BREAK = bytes(b if b in _WORD_BYTES else 32 for b in range(256))

SPAN = "struct<label:string,template:int,first_word:bigint,last_word:bigint,cover:double>"


def words_of(text: bytes) -> list[bytes]:
    return ascii_lower(text).translate(_BREAK).split()


class Automaton:
    """Suffix automaton of several token strings, with the places where each state's strings end."""

    def __init__(self, strings: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, string in enumerate(strings):
            last = 0
            for place, token in enumerate(string):
                last = self._extend(last, token)
                while len(own) < len(self.link):
                    own.append([])
                own[last].append((number, place))
        # ends of a state: its own and those of all states that link to it, longest first
        self.ends = [list(o) for o in own]
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new = self._state(self.length[last] + 1, {}, -1)
        state = last
        while state != -1 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state == -1:
            self.link[new] = 0
        else:
            known = self.next[state][token]
            self.link[new] = known if self.length[known] == self.length[state] + 1 else self._split(state, token, known)
        return new

    def _split(self, state: int, token: int, known: int) -> int:
        short = self._state(self.length[state] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = short
        while state != -1 and self.next[state].get(token) == known:
            self.next[state][token] = short
            state = self.link[state]
        return short

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def statistics(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest string ending here) after each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            found = self.next[state].get(token)
            if found is not None:
                state, length = found, length + 1
            yield state, length


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]], phrases: Mapping[str, str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.labels: list[str] = []
        strings = []
        for label, texts in templates.items():
            for text in texts:
                strings.append(self._tokens(text))
                self.labels.append(label)
        self.sizes = [len(s) for s in strings]
        self.phrase_labels = list(phrases.values())
        phrase_strings = [self._tokens(p) for p in phrases]
        self.automaton = Automaton(strings + phrase_strings)
        self.shortest = min([MIN_RUN, *map(len, phrase_strings)])
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for number, string in enumerate(phrase_strings):
            for state, _ in self.automaton.statistics(string):
                pass
            self.phrases[state].append((number, len(string)))
        for state in sorted(range(1, len(self.automaton.link)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = self.phrases[state] + self.phrases[self.automaton.link[state]]
        self.ends = [[e for e in ends if e[0] < len(strings)] for ends in self.automaton.ends]

    def _tokens(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple]]:
        """(words, base places as (first word, phrase), spans)."""
        words = words_of(text)
        tokens = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], tokens >= 0, [False])).astype(np.int8)))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []  # template, first word, last word, first word of the template
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first < self.shortest:
                continue  # no word outside the templates' vocabulary can be part of a match
            found = list(self.automaton.statistics(tokens[first:end].tolist()))
            for at, (state, length) in enumerate(found):
                for phrase, size in self.phrases[state]:
                    if size <= length:
                        places.append((first + at - size + 1, phrase))
                if length >= MIN_RUN and (at + 1 == len(found) or found[at + 1][1] <= length):
                    begin = first + at - length + 1
                    matches += [(t, begin, first + at, e - length + 1) for t, e in self.ends[state]]
        return len(words), places, self.spans(matches)

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple]:
        """(label, template, first word, last word, cover) of the best chain of each cluster of matches."""
        out = []
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, first, last, start in matches:
            by.setdefault(t, []).append((last, first, start, start + last - first))
        for t, found in by.items():
            found.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain ending here, its first word
            cluster: tuple[int, int, int] | None = None  # words covered, first, last word
            reach = -1
            for j, (last, first, start, end) in enumerate(found):
                if cluster and first > reach + MAX_GAP + 1:
                    out.append((t, *cluster))
                    cluster = None
                here = (last - first + 1, first)
                for i in range(j - 1, -1, -1):
                    last_i, first_i, start_i, end_i = found[i]
                    if first - last_i > MAX_GAP + 1:
                        break
                    if first > first_i and start > start_i and start - end_i <= MAX_GAP + 1:
                        more = last - first + 1 - max(0, last_i - first + 1, end_i - start + 1)
                        if more > 0 and best[i][0] + more > here[0]:
                            here = (best[i][0] + more, best[i][1])
                best.append(here)
                reach = max(reach, last)
                if not cluster or here[0] > cluster[0]:
                    cluster = (here[0], here[1], last)
            if cluster:
                out.append((t, *cluster))
        covered = [(self.labels[t], t, first, last, n / self.sizes[t]) for t, n, first, last in out]
        return sorted((s for s in covered if s[4] >= MIN_COVER), key=lambda s: (s[2], s[3], s[1]))


def licences(
    docs: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    `labels` has those of the base phrases and of all covered templates. The score is the largest cover, 1 where a base
    phrase stands, 0 without either. A span is (label, template's number, first and last word, cover). Null and empty texts
    have no word, empty labels and score 0; rows without an id and repeated rows are scanned like any other.
    """
    templates, phrases = dict(templates), dict(phrases)

    def scan(rows: Iterable[tuple]) -> Iterator[tuple]:
        scanner = Scanner(templates, phrases)
        for name, text in rows:
            n, places, spans = scanner.scan(text)
            base = {scanner.phrase_labels[p] for _, p in places}
            starts = [s for s, _ in places]
            score = 1.0 if places else max((s[4] for s in spans), default=0.0)
            yield (
                name, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s[0] for s in spans})), min(1.0, score),
                [dict(zip(("label", "template", "first_word", "last_word", "cover"), s)) for s in spans],
            )

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        f"score double, spans array<{SPAN}>"
    )
    return stream(pick(docs, doc_id=long_id(doc_id), text=filled(text)), scan, schema, as_bytes=("text",))


def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences(table(spark, folder, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("bigint")).drop("spans")
