"""Licence scans by matching statistics against a suffix automaton of licence words.

The words of all templates and phrases make one generalised suffix automaton. Each text is streamed
through it: after each word the automaton holds the longest run of words, ending there, that any
template has (its matching statistics). Where such a run ends that is long enough, it becomes a
match; matches that follow each other in the text and in one template, without a wide gap, are
chained, and a chain that covers enough of its template is a span with that template's label.
Whole phrases are read off the same states, by their links, so every place of a phrase is found.

Words that no template has, and pairs of neighbours that none has, end every match; only the runs
between them are streamed. Each document is a row of its own: nothing is shuffled, and the
templates are a fixed list. Null and empty texts have no words, no spans and a score of 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.automaton import Automaton
from notespan.llm.common import Words, columns, documents, table

# The phrases whose every place counts, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of public licences and of the notices that refer to them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

# Bytes between words: all of ASCII but digits and small letters.
BETWEEN = np.array([b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 for b in range(256)])


@dataclass(frozen=True)
class Rules:
    """least: words of a match that counts; gap: words of the text that may stand between two matches of a chain; share: of a template that a span must cover."""

    least: int = 3
    gap: int = 12
    share: float = 0.7


def words_of(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return Words(data, np.array([0, len(data)]), BETWEEN)


class Licences:
    """The automaton of templates and phrases, with the places that each state stands for."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], rules: Rules):
        self.rules = rules
        hashes = [words_of(t).hash for t, _ in phrases] + [words_of(t).hash for _, t in templates]
        #: Words of the shortest run that is streamed: a phrase may be shorter than a match that counts.
        self.least = max(1, min([rules.least, *(len(h) for h in hashes[: len(phrases)] if len(h))]))
        self.known = np.unique(np.concatenate(hashes))
        strings = [np.searchsorted(self.known, h).tolist() for h in hashes]
        n = len(self.known)
        self.pairs = np.unique([a * n + b for s in strings for a, b in zip(s, s[1:], strict=False)])
        self.auto = Automaton(strings)
        self.phrases = [label for _, label in phrases]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in strings]
        # Of each state that is a whole phrase: the phrases (several strings may be equal).
        self.spoken: dict[int, list[int]] = {}
        for p, s in enumerate(strings[: len(phrases)]):
            state = functools.reduce(lambda at, w: self.auto.next[at][w], s, 0)
            self.spoken.setdefault(state, []).append(p)
        # Of each state: the templates that have its run of words, and all places where it ends in each.
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.auto.link]
        for k, s in enumerate(strings[len(phrases) :]):
            state = 0
            for end, w in enumerate(s, 1):
                state = self.auto.next[state][w]
                up = state
                while up > 0:
                    self.ends[up].setdefault(k, []).append(end)
                    up = self.auto.link[up]

    def runs(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """Text, place and numbers of the words, where enough words stand together that templates have in pairs."""
        h = words.hash
        if len(h) < self.least:
            return
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        fits = self.known[at] == h
        n = len(self.known)
        pair = at[:-1] * n + at[1:]
        near = np.flatnonzero(fits[:-1] & fits[1:] & (words.text_of[:-1] == words.text_of[1:]))
        near = near[np.isin(pair[near], self.pairs)]
        if self.least == 1:  # single words may be phrases
            alone = np.setdiff1d(np.flatnonzero(fits), np.concatenate([near, near + 1]))
            for k in alone.tolist():
                yield int(words.text_of[k]), int(k - words.first[words.text_of[k]]), at[k : k + 1].tolist()
        if not len(near):
            return
        cut = np.flatnonzero(np.diff(near) > 1) + 1
        for run in np.split(near, cut):
            if len(run) + 1 >= self.least:
                text = int(words.text_of[run[0]])
                yield text, int(run[0] - words.first[text]), at[run[0] : run[-1] + 2].tolist()

    def stream(self, start: int, numbers: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases (phrase, first word), and matches (first word, words, state)."""
        auto, phrases, matches = self.auto, [], []
        state = matched = 0
        for i, w in enumerate(numbers, start + 1):
            before = state, matched
            state, matched = auto.step(state, matched, w)
            if before[1] >= self.rules.least and matched <= before[1]:
                matches.append((i - 1 - before[1], before[1], before[0]))
            found = auto.at[state] if matched == auto.length[state] else auto.at[auto.link[state]]
            while found > 0:
                phrases += [(p, i - self.sizes[p]) for p in self.spoken.get(found, ())]
                found = auto.at[auto.link[found]]
        if matched >= self.rules.least:
            matches.append((start + len(numbers) - matched, matched, state))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """The spans: label, first word, word after the last, share of the template covered."""
        by: dict[int, list[tuple[int, int, list[int]]]] = {}
        for start, n, state in matches:
            for k, ends in self.ends[state].items():
                by.setdefault(k, []).append((start, n, [end - n for end in ends]))
        spans, skip = [], len(self.phrases)
        for k, found in by.items():
            size, chain = self.sizes[skip + k], []
            for m in [*found, None]:
                if m and chain:
                    text_end, place_end = chain[-1][0] + chain[-1][1], chain[-1][2] + chain[-1][1]
                    # Of the template's places that go on from the chain, the one that overlaps it least, and then the nearest.
                    over = [(max(0, text_end - m[0], place_end - p), p) for p in m[2] if p + m[1] > place_end]
                    if over and m[0] - text_end <= self.rules.gap and min(over)[0] < m[1]:
                        skipped, place = min(over)
                        chain.append((m[0] + skipped, m[1] - skipped, place + skipped))
                        continue
                if chain and (share := sum(c[1] for c in chain) / size) > 0:
                    spans.append({"label": self.labels[k], "start": chain[0][0], "end": chain[-1][0] + chain[-1][1], "share": share})
                chain = [(m[0], m[1], m[2][0])] if m else []
        return spans


@functools.lru_cache(maxsize=4)
def licences(templates: tuple, phrases: tuple, rules: Rules) -> Licences:
    return Licences(templates, phrases, rules)


PLACE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, places (label, start) of whole phrases, spans (label, start, end, share) of chained matches, of any share; words count from 0."""
    key = tuple(templates), tuple(phrases.items()), rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = licences(*key)
        for batch in batches:
            for rows, data, bounds in columns(batch, lower=True):
                words = Words(data, bounds, BETWEEN)
                places: list[list] = [[] for _ in range(len(bounds) - 1)]
                matches: list[list] = [[] for _ in places]
                for text, start, numbers in own.runs(words):
                    p, m = own.stream(start, numbers)
                    places[text] += [{"label": own.phrases[x], "start": at} for x, at in p]
                    matches[text] += m
                spans = [own.chains(m) if m else [] for m in matches]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(np.diff(words.first).astype(np.int64)), pa.array(places, PLACE), pa.array(spans, SPAN)], names=["doc_id", "n_words", "places", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, start: long>>, spans array<struct<label: string, start: long, end: long, share: double>>")


def labelled(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: the phrases' places, the labels of phrases and of spans that cover enough, and the largest share covered."""
    found = scan(docs, rules=rules)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    more = F.transform(F.filter("spans", lambda s: s["share"] >= rules.share), lambda s: s["label"])
    starts = F.transform("places", lambda p: p["start"])
    shares = F.transform("spans", lambda s: F.least(s["share"], F.lit(1.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"))
