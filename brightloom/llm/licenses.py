"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A file's words are streamed through it, which gives at
each word the longest run ending there that some template holds (matching statistics). Maximal long runs
are anchored at their places in the templates, anchors in the same order in file and template are chained, and
a template whose words a chain covers well enough labels the file with that span. The phrases are templates
too: one of them ends at a word if its state lies on the suffix path of the word's state and it is no longer than the run.
"""

from __future__ import annotations

import bisect
import itertools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose every place counts, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Passages of public licences and notices, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of a run from which on it is an anchor (or the whole template, if that is shorter).
MIN_RUN = 4
#: Words that may lie between anchors of a chain, and the share of a template that a chain must cover.
GAP, COVER = 8, 0.8
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Word bytes are letters and digits of ASCII, A-Z as a-z, and whatever is not ASCII; others separate.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places where each state's strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((t, i))
        self.ends = [list(e) for e in ends]
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):  # ends pass to the suffixes
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]

    def _state(self, like: int | None, length: int, ends: list) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int, ends: list) -> int:
        """The state of p's longest string and word, taken out of q if q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(q, self.length[p] + 1, ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word], ends)
        new = self._state(None, self.length[last] + 1, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word], ends)
        return new

    def step(self, v: int, n: int, word: int) -> tuple[int, int]:
        """The state and length of the longest run after one more word."""
        while v and word not in self.next[v]:
            v = self.link[v]
            n = self.length[v]
        return (self.next[v][word], n + 1) if word in self.next[v] else (0, 0)


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids) + 1) for w in split(t.encode())] for t in [*phrases, *(t for _, t in templates)]]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.sizes, self.n_phrases = [len(c) for c in coded], len(phrases)
        self.shortest = min(MIN_RUN, *self.sizes)
        self.automaton = a = Automaton(coded)
        own: dict[int, list[int]] = {}
        for t in range(len(coded)):
            v = 0
            for word in coded[t]:
                v = a.next[v][word]
            own.setdefault(v, []).append(t)
        self.whole_at: list[list[int]] = [[] for _ in a.link]
        for v in sorted(range(len(a.link)), key=lambda v: a.length[v]):
            self.whole_at[v] = own.get(v, []) + (self.whole_at[a.link[v]] if v else [])

    def words(self, text: str | None) -> np.ndarray:
        """Template word numbers of a text's words, 0 for words of no template."""
        data, found, at = (text or "").encode(), [], 0
        while at < len(data):
            end = at + PIECE
            while end < len(data) and _WORDS[data[end]] != 32:
                end += 1
            some = split(data[at:end])
            found.append(np.fromiter(map(self.ids.get, some, itertools.repeat(0)), np.int32, len(some)))
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def scan(self, text: str | None) -> dict:
        """n_words, phrases (start, label) and spans (label, first word, word after the last, share covered) of a text."""
        words = self.words(text)
        held = np.flatnonzero(words)
        breaks = np.flatnonzero(np.diff(held) != 1) + 1
        starts, stops = np.r_[0, breaks], np.r_[breaks, len(held)]
        long = stops - starts >= self.shortest
        phrases: list[tuple[int, str]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self._stream(int(held[s]), words[held[s] : held[s] + e - s].tolist(), phrases, anchors)
        spans = [(self.labels[t], *span) for t, of in anchors.items() for span in self._chains(t, of)]
        return {"n_words": len(words), "phrases": phrases, "spans": sorted(spans, key=lambda s: (s[1], s[2], s[0]))}

    def _stream(self, at: int, run: list[int], phrases: list, anchors: dict) -> None:
        a, v, n = self.automaton, 0, 0
        for i, word in enumerate([*run, 0], at):
            was, had = v, n
            v, n = a.step(v, n, word) if word else (0, 0)
            if had and n <= had:  # the run that ended one word before is maximal
                for t, end in a.ends[was]:
                    if t >= self.n_phrases and had >= min(MIN_RUN, self.sizes[t]):
                        anchors.setdefault(t, []).append((i - had, end - had + 1, had))
            for t in self.whole_at[v]:  # sequences that end here whole, also within a longer template's run
                if self.sizes[t] <= n and t < self.n_phrases:
                    phrases.append((i - self.sizes[t] + 1, self.labels[t]))
                elif self.sizes[t] <= n:
                    anchors.setdefault(t, []).append((i - self.sizes[t] + 1, 0, self.sizes[t]))

    def _chains(self, t: int, anchors: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, float]]:
        """Disjoint spans that chains of anchors (place in file, place in template, words) cover, best covered first.

        Each anchor continues the chain that makes it cover most, of those that end within GAP words before it in file and template. Chains are kept by their
        ends in the template and leave once the file has gone past them, so an anchor looks at as many places as the template and the gap have.
        """
        ends: list[tuple[int, int, int]] = []  # words covered, first word, word after the last
        at_end: dict[int, deque[int]] = {}
        for f, p, n in sorted(set(anchors)):
            best = (n, f, f + n)
            for end in range(max(0, p - GAP), p + n):
                held = at_end.get(end, deque())
                while held and ends[held[0]][2] + GAP < f:
                    held.popleft()
                for k in reversed(held):
                    covered, first, stop = ends[k]
                    cut = max(stop - f, end - p, 0)  # words that both hold count once
                    if cut < n and f + cut - stop <= GAP and p + cut - end <= GAP and covered + n - cut > best[0]:
                        best = (covered + n - cut, first, f + n)
            at_end.setdefault(p + n, deque()).append(len(ends))
            ends.append(best)
        taken: list[tuple[int, int]] = []
        for covered, first, stop in sorted(ends, key=lambda e: (-e[0], e[1], e[2])):
            if covered < COVER * self.sizes[t]:
                break
            i = bisect.bisect_left(taken, (first, stop))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or taken[i][0] >= stop):
                taken.insert(i, (first, stop))
                yield first, stop, min(1.0, covered / self.sizes[t])


_SCANNER: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, phrases and spans of every row of ``docs`` (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array([[{"word": w, "label": n} for w, n in x["phrases"]] for x in found], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                    pa.array([[{"label": n, "first": f, "stop": s, "covered": c} for n, f, s, c in x["spans"]] for x in found], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())]))),
                ],
                names=["doc_id", "n_words", "phrases", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, phrases array<struct<word:long,label:string>>, spans array<struct<label:string,first:long,stop:long,covered:double>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 for a phrase, else the best cover) of every row.

    A null or empty text has no words, no labels and score 0. Rows are scanned one by one, so repeated ones get the same and ids don't matter; other columns are ignored; an empty table gives an empty one.
    """
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max("spans.covered"), F.lit(0.0))
    return spans(docs).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "spans.label")).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )
