"""Operator 1, licence scans: a generalised suffix automaton over the word tokens of licence texts.

A document's words are streamed through the automaton, which gives matching statistics: at each word, the longest
factor of any template that ends there. Phrases are templates like the others and are read off the statistics: a
phrase ends at a word when its state is that word's state or an ancestor of it, and the match is long enough.
Maximal matches of ``min_match`` words or more are chained, in order of both text and template, into covered spans.

Defined cases: a null or empty text has 0 words, no labels and score 0; a null doc_id stays null; repeated rows are
scanned each; an empty table gives no rows; other columns are not read; a known word whose neighbours aren't its neighbours in any
template reaches the automaton only where a phrase or the least match is one word long.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.textkit import NOT_ALNUM, Words, lower_ascii, map_slices, raw_bytes, text_of

# Fixed: base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed: public licence texts and notices, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/.""",
}

SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>,
    score double, spans array<struct<label: string, start: long, end: long, covered: double>>"""


def words_of(text: str) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case."""
    data, bounds = raw_bytes(pa.array([text]))
    return Words(lower_ascii(data), bounds, NOT_ALNUM).hash


@dataclass
class LicenceScanner:
    """``phrases`` map word sequences to base labels, ``templates`` label texts."""

    phrases: Mapping[str, str] = field(default_factory=lambda: PHRASES)
    templates: Mapping[str, str] = field(default_factory=lambda: TEMPLATES)
    min_match: int = 5
    max_gap: int = 12
    min_cover: float = 0.5

    def __post_init__(self):
        texts = [*self.phrases, *self.templates.values()]
        self.names = [*self.phrases.values(), *self.templates]
        hashes = [words_of(t) for t in texts]
        self.vocabulary = np.unique(np.concatenate(hashes))
        strings = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.lengths = [len(s) for s in strings]
        n = len(self.vocabulary)
        self.bigrams = np.unique([a * n + b for s in strings for a, b in zip(s, s[1:], strict=False)])
        short = strings if self.min_match < 2 else [s for s in strings[: len(self.phrases)] if len(s) == 1]
        self.alone = np.unique(np.concatenate([np.zeros(0, np.int64), *map(np.array, short)]))  # tokens that can match by themselves
        self.automaton = auto = SuffixAutomaton()
        prefixes = [auto.add(s) for s in strings]
        # Of each state: where its factors end in the templates, and the phrases that are suffixes of its longest factor.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in auto.size]
        for k, states in enumerate(prefixes):
            for at, state in enumerate(states):
                self.ends[state].append((k, at))
        for v in auto.by_size():
            self.ends[auto.link[v]] += self.ends[v]
        whole = {}
        for k in range(len(self.phrases)):
            state = 0
            for token in strings[k]:
                state = auto.next[state][token]
            whole.setdefault(state, []).append(k)
        self.phrases_at: list[tuple[int, ...]] = [()] * len(auto.size)
        for v in reversed(auto.by_size()):
            self.phrases_at[v] = (*whole.get(v, ()), *self.phrases_at[auto.link[v]])

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens of a slice (-1: none) and the bounds of runs whose neighbours are neighbours in some template."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        tokens = np.where(self.vocabulary[at] == words.hash, at, -1)
        pairs = np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] * len(self.vocabulary) + tokens[1:], -1)
        doc = words.doc_of()
        good = np.isin(pairs, self.bigrams) & (doc[:-1] == doc[1:])
        edge = np.diff(good.astype(np.int8), prepend=0, append=0)
        lows, highs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if len(self.alone):
            single = np.isin(tokens, self.alone)
            single[:-1] &= ~good
            single[1:] &= ~good
            lows = np.concatenate([lows, np.flatnonzero(single)])
            highs = np.concatenate([highs, np.flatnonzero(single) + 1])
            order = np.argsort(lows)
            lows, highs = lows[order], highs[order]
        return tokens, lows, highs

    def scan(self, tokens: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (start, phrase) and maximal matches (start, end, state) of one run; ``start``: its first word's number."""
        found, matches = [], []
        statistics = self.automaton.statistics(tokens)
        for i, (state, length) in enumerate(statistics):
            for k in self.phrases_at[state]:
                if length >= self.lengths[k]:
                    found.append((start + i + 1 - self.lengths[k], k))
            if length >= self.min_match and (i + 1 == len(statistics) or statistics[i + 1][1] != length + 1):
                matches.append((start + i + 1 - length, start + i + 1, state))
        return found, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, start, end, covered share of the template) from a document's maximal matches."""
        spans: list[tuple[str, int, int, float]] = []
        open_: dict[int, list[list[int]]] = {}
        for start, end, state in sorted(matches):
            places: dict[int, list[int]] = {}
            for k, at in self.ends[state]:
                if k >= len(self.phrases):
                    places.setdefault(k, []).append(at)
            for k, lasts in places.items():
                # Where the factor stands more than once in a template, the place that prolongs the best chain counts.
                fits = [(c[2], -last, c) for last in lasts for c in open_.get(k, ()) if start - c[1] <= self.max_gap and c[3] <= last]
                _, at, best = max(fits, key=lambda f: f[:2], default=(0, -min(lasts), None))
                last, first = -at, 1 - at - (end - start)
                new = [start, end, end - start, last + 1]
                if best is not None:
                    overlap = max(0, best[1] - start, best[3] - first)
                    if (fresh := end - start - overlap) <= 0:
                        continue
                    new = [best[0], max(end, best[1]), best[2] + fresh, last + 1]
                    open_[k].remove(best)
                open_.setdefault(k, []).append(new)
        for k, chains in open_.items():
            spans += [(self.names[k], c[0], c[1], min(1.0, c[2] / self.lengths[k])) for c in chains]
        return sorted(spans)

    def __call__(self, piece: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = raw_bytes(text_of(piece))
        words = Words(lower_ascii(data), bounds, NOT_ALNUM)
        tokens, lows, highs = self.runs(words)
        docs = np.searchsorted(words.offsets, lows, "right") - 1
        found: dict[int, list] = {}
        matches: dict[int, list] = {}
        for low, high, doc in zip(lows.tolist(), highs.tolist(), docs.tolist(), strict=True):
            places, maximal = self.scan(tokens[low:high].tolist(), low - int(words.offsets[doc]))
            if places:
                found.setdefault(doc, []).extend(places)
            if maximal:
                matches.setdefault(doc, []).extend(maximal)
        rows = []
        for doc, n in enumerate(words.counts.tolist()):
            places = found.get(doc, [])
            base = {self.names[k] for _, k in places}
            spans = self.chain(matches[doc]) if doc in matches else []
            more = {s[0] for s in spans if s[3] >= self.min_cover}
            score = 1.0 if places else max((s[3] for s in spans), default=0.0)
            starts = [s for s, _ in places]
            rows.append((n, len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | more), score, spans))
        columns = list(zip(*rows, strict=True))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), span]
        columns[7] = [[dict(zip(("label", "start", "end", "covered"), s, strict=True)) for s in spans] for spans in columns[7]]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def scan_licences(docs: DataFrame, scanner: LicenceScanner | None = None) -> DataFrame:
    """Base phrases, labels, score and covered template spans of each document."""
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scanner or LicenceScanner(), SCHEMA)


def licence_digest(docs: DataFrame) -> DataFrame:
    """``scan_licences`` with labels as strings."""
    out = scan_licences(docs)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"))
