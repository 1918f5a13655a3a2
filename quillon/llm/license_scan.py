"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates and phrases. A text is streamed through it: at each word the
matching statistic is the longest run of words ending there that some template holds. A maximal match of at least
LEAST words is credited to the templates that hold it, and its longest runs to the templates that hold only a part of
it (a short template may end or lie inside of a match of a longer one). Runs of different matches are chained in text and template
order, gaps of at most GAP words; a template is found where a chain covers COVERED of it. Two parts of one match are no
chain: "Attribution ShareAlike 4.0" is no "Attribution 4.0". Phrases are found where the statistic's state has the phrase as a suffix.

Only words of the vocabulary whose neighbour follows them in some template can give a statistic of two or more; the
others are passed over with numpy, and the automaton steps through the runs that are left. Phrases have two words at least.

Edge cases: a null or empty text has no words and score 0; a null doc_id keeps its row; repeated rows are scanned one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches
from quillon.llm.textkern import ALNUM, Words, slices

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Sentences of public licences and the licences' labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Licensed under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Apache License Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST, GAP, COVERED = 3, 4, 0.75


def words_of(text: str) -> list[str]:
    return "".join(c if c.isalnum() and (c.isascii()) or ord(c) > 127 else " " for c in text.lower()).split()


class Automaton:
    """States with their longest run (length), suffix link, next states by token, and for each text that holds the
    state's run one place where it ends."""

    def __init__(self, texts: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[dict[int, int]] = [{}]
        for t, text in enumerate(texts):
            last = 0
            for i, token in enumerate(text):
                last = self._extend(last, token)
                self.ends[last].setdefault(t, i + 1)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for t, end in self.ends[v].items():
                self.ends[self.link[v]].setdefault(t, end)

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length), self.link.append(link), self.next.append(follow), self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's longest run with token behind it, cut out of p's next state if that is longer."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        cut = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = cut
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = cut
            p = self.link[p]
        return cut

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The matching statistic with one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], length + 1
        return 0, 0


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        texts = [words_of(t) for _, t in templates] + [words_of(p) for p, _ in phrases]
        self.labels = [x for x, _ in templates]
        self.phrase_labels = [x for _, x in phrases]
        self.sizes = [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = [[number[w] for w in t] for t in texts]
        self.automaton, self.coded = Automaton(coded), coded
        self.known_credits: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        # phrases by state: those that the state's runs end with
        home = {}
        for k, t in enumerate(coded[len(templates) :]):
            s = 0
            for token in t:
                s = self.automaton.next[s][token]
            home.setdefault(s, []).append((k, len(t)))
        order = sorted(range(1, len(self.automaton.length)), key=self.automaton.length.__getitem__)
        self.phrases = [[] for _ in self.automaton.length]
        for v in order:
            self.phrases[v] = home.get(v, []) + self.phrases[self.automaton.link[v]]
        joined = "\n".join(vocabulary).encode()
        table = Words(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]), ALNUM).hashes(lower=True)
        assert len(table) == len(vocabulary)
        self.token_order = np.argsort(table)
        self.hashes = table[self.token_order]
        pairs = sorted({a * len(vocabulary) + b for t in coded for a, b in zip(t, t[1:], strict=False)})
        self.pairs = np.array(pairs, dtype=np.int64)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each word, -1 for others."""
        i = np.searchsorted(self.hashes, hashes)
        i[i == len(self.hashes)] = 0
        return np.where(self.hashes[i] == hashes, self.token_order[i], -1)

    def runs(self, token: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which each neighbour pair stands in some template."""
        at = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0) & (doc[:-1] == doc[1:]))
        code = token[at] * len(self.hashes) + token[at + 1]
        i = np.searchsorted(self.pairs, code)
        i[i == len(self.pairs)] = 0
        at = at[self.pairs[i] == code]
        if not len(at):
            return []
        breaks = np.flatnonzero(np.diff(at) > 1)
        return list(zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + 2).tolist(), strict=True))

    def scan(self, token: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (phrase, start) and maximal matches (start, length, state) of one run of tokens."""
        found, matches = [], []
        state = length = 0
        a = self.automaton
        for i, t in enumerate(token):
            before = (state, length)
            state, length = a.step(state, length, t)
            if length <= before[1] and before[1] >= LEAST:
                matches.append((i - before[1], before[1], before[0]))
            for k, n in self.phrases[state]:
                if length >= n:
                    found.append((k, i - n + 1))
        if length >= LEAST:
            matches.append((len(token) - length, length, state))
        return found, matches

    def holders(self, state: int, length: int) -> dict[int, tuple[int, int]]:
        """Of each template that holds LEAST words or more of the end of the state's run of this length: how many, and where they end in it."""
        a, found = self.automaton, {}
        while length >= LEAST:
            for t, end in a.ends[state].items():
                if t < len(self.labels):
                    found.setdefault(t, (length, end))
            state = a.link[state]
            length = a.length[state]
        return found

    def credits(self, state: int, length: int) -> list[tuple[int, int, int, int]]:
        """(template, start, length, template end) of each template's maximal runs within a match; all of it where it holds that."""
        if (state, length) not in self.known_credits:
            whole = self.automaton.ends[state]
            text, end = next(iter(whole.items()))
            out, before, s, n = [], {}, 0, 0
            for i, token in enumerate([*self.coded[text][end - length : end], None]):
                now = {}
                if token is not None:
                    s, n = self.automaton.step(s, n, token)
                    now = self.holders(s, n)
                out += [(t, i - k, k, e) for t, (k, e) in before.items() if now.get(t, (0, 0))[0] <= k and (t not in whole or k == length)]
                before = now
            self.known_credits[state, length] = out
        return self.known_credits[state, length]

    def chained(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """Best covered share of each template by chains of runs in the text's order, no two of one match."""
        best: dict[int, float] = {}
        chains: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # template, text end: template end, words, end of the match
        for at, size, state in matches:
            fresh = []
            for t, offset, length, end in self.credits(state, size):
                start, had = at + offset, 0
                for text_end in range(start - GAP, min(start, at) + 1):
                    for template_end, words, match_end in chains.get((t, text_end), ()):
                        if match_end <= start and 0 <= end - length - template_end <= GAP:
                            had = max(had, words)
                fresh.append(((t, start + length), (end, had + length, at + size)))
                best[t] = max(best.get(t, 0.0), min(1.0, (had + length) / self.sizes[t]))
            for place, chain in fresh:
                chains.setdefault(place, []).append(chain)
        return best


@functools.cache
def default_scanner() -> Scanner:
    return Scanner()


COLUMNS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "template_words": pa.int64()}


def _scan(batches):
    scanner = default_scanner()
    for batch, buf, bounds in slices(batches):
        words = Words(buf, bounds, ALNUM)
        doc = words.doc()
        token = scanner.tokens(words.hashes(lower=True))
        places: dict[int, list[tuple[int, int]]] = {}
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in scanner.runs(token, doc) if len(token) > 1 else ():
            d = int(doc[a])
            base = a - int(words.first[d])
            found, whole = scanner.scan(token[a:b].tolist())
            if found:
                places.setdefault(d, []).extend((k, base + i) for k, i in found)
            if whole:
                matches.setdefault(d, []).extend((base + i, n, s) for i, n, s in whole)
        out = []
        for d, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), words.counts.tolist(), strict=True)):
            own, cover = places.get(d, []), scanner.chained(matches.get(d, []))
            starts = [i for _, i in own]
            base = {scanner.phrase_labels[k] for k, _ in own}
            more = {scanner.labels[t] for t, share in cover.items() if share >= COVERED}
            share = 1.0 if own else max(cover.values(), default=0.0)
            out.append((doc_id, n, len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), share, sum(x[1] for x in matches.get(d, ()))))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_words of every row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_words long")
