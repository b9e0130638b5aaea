"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton is built once from the templates (a bounded list that the caller supplies) and sent to the tasks. A text is
streamed through it word by word: the state is the longest run of words ending here that stands in some template
(matching statistics), and its suffix links hold the longest run of every other template. Where a template's own run
cannot be extended it is a maximal match, whatever other templates hold, so a notice inside a longer one is found too;
long matches of one template that follow each other in the text and in the template are chained into a span, and a span
that covers enough of its template gives the template's label. Phrases are templates too, and every place of a phrase is
counted on the way.

One pass over each text, linear in its words, in Arrow batches; no shuffle. Texts are handled as UTF-8 bytes, where
lower-casing A-Z and the word pattern mean the same as on characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that a text is searched for and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public notices as they stand in files.
NOTICES = (
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version.", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation.", "lgpl"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction.", "mit"),
    ("Released under the MIT License.", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met.", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
)


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())  # bytes.lower touches A-Z only


@dataclass
class _State:
    length: int
    link: int = -1
    step: dict[bytes, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)  # (template, place of its last word)


@dataclass(frozen=True)
class ScanSettings:
    min_match: int = 3        # words of a match that may join a chain
    max_gap: int = 8          # words between two matches of a chain
    min_coverage: float = 0.8  # share of a template's words that a span must cover


class LicenseAutomaton:
    """Generalised suffix automaton over the templates' words."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, settings: ScanSettings = ScanSettings()):
        self.settings = settings
        self.templates = [(words_of(t.encode()), label) for t, label in notices]
        self.states = [_State(0)]
        for number, (words, _) in enumerate(self.templates):
            self._add(words, number)
        listed = [(words_of(t.encode()), label) for t, label in phrases]
        for words, _ in listed:
            self._add(words, None)
        for state in sorted(self.states, key=lambda s: -s.length):
            if state.link > 0:
                self.states[state.link].ends |= state.ends
        # Phrases that end wherever a state is reached by a long enough match.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.states]
        for words, label in listed:
            own = 0
            for w in words:
                own = self.states[own].step[w]
            for s in range(1, len(self.states)):
                up = s
                while up > 0 and up != own:
                    up = self.states[up].link
                if up == own:
                    self.phrases[s].append((len(words), label))
        self.stops: dict[tuple[int, int], tuple[list, list]] = {}  # filled by _stopped

    def _add(self, words: list[bytes], number: int | None) -> None:
        last = 0
        for place, word in enumerate(words):
            last = self._extend(last, word)
            if number is not None:
                self.states[last].ends.add((number, place))

    def _extend(self, last: int, word: bytes) -> int:
        states = self.states
        known = states[last].step.get(word)
        if known is not None:  # an earlier template already has this run
            return known if states[known].length == states[last].length + 1 else self._split(last, word, known)
        new = len(states)
        states.append(_State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].step:
            states[at].step[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            target = states[at].step[word]
            exact = states[target].length == states[at].length + 1
            states[new].link = target if exact else self._split(at, word, target)
        return new

    def _split(self, at: int, word: bytes, target: int) -> int:
        """Part of ``target`` that is one word longer than ``at`` becomes a state of its own."""
        states = self.states
        half = len(states)
        states.append(_State(states[at].length + 1, states[target].link, dict(states[target].step)))
        states[target].link = half
        while at >= 0 and states[at].step.get(word) == target:
            states[at].step[word] = half
            at = states[at].link
        return half

    def _runs(self, state: int) -> dict[int, tuple[int, list[int]]]:
        """Per template the state on the suffix path that holds its longest run, and the places where that run ends."""
        runs: dict[int, tuple[int, list[int]]] = {}
        at = state
        while at > 0 and (at == state or self.states[at].length >= self.settings.min_match):
            for template, place in sorted(self.states[at].ends):
                if runs.setdefault(template, (at, []))[0] == at:
                    runs[template][1].append(place)
            at = self.states[at].link
        return runs

    def _stopped(self, old: int, new: int) -> tuple[list, list]:
        """Runs that end with the step from ``old`` to ``new``: (template, place) of the full match, (length, template,
        place) of shorter ones."""
        if (old, new) not in self.stops:
            states, after = self.states, self._runs(new)
            source = old  # the state on the suffix path that the step starts from
            while source > 0 and new not in states[source].step.values():
                source = states[source].link
            full, shorter = [], []
            for template, (at, places) in self._runs(old).items():
                held = after.get(template, (0, []))[0]
                if at == source if held == new else states[held].length == states[at].length + 1 and at != old:
                    continue  # one word longer now
                if at == old:
                    full += [(template, p) for p in places]
                else:
                    shorter += [(states[at].length, template, p) for p in places]
            self.stops[old, new] = full, shorter
        return self.stops[old, new]

    def scan(self, words: list[bytes], per_template: bool = False) -> tuple[list[tuple[int, str]],
                                                                            list[tuple[int, int, int, int]]]:
        """Places (start, label) of phrases, and maximal matches (end, length, template, template end).

        The matches are those of the longest runs, or with ``per_template`` those of every template by itself.
        """
        states, phrases, shortest = self.states, self.phrases, self.settings.min_match
        places, matches = [], []
        root, state, length = states[0].step, 0, 0
        for at, word in enumerate(words):
            old, run = state, length
            if not state:
                state = root.get(word, 0)
                length = 1 if state else 0
            else:
                following = states[state].step.get(word)
                if following is None:
                    while state and word not in states[state].step:
                        state = states[state].link
                        length = states[state].length
                    following = states[state].step.get(word)
                if following is None:
                    state = length = 0
                else:
                    state, length = following, length + 1
            if run >= shortest and (per_template or length <= run):
                matches += self._matches(at - 1, run, old, state, per_template)
            if state and phrases[state]:
                places += [(at - n + 1, label) for n, label in phrases[state] if n <= length]
        if length >= shortest:
            matches += self._matches(len(words) - 1, length, state, 0, per_template)
        return places, matches

    def _matches(self, at: int, length: int, old: int, new: int, per_template: bool) -> list[tuple[int, int, int, int]]:
        full, shorter = self._stopped(old, new)
        found = [(at, length, t, end) for t, end in full]
        return found + [(at, n, t, end) for n, t, end in shorter] if per_template else found

    def spans(self, matches) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, coverage) of chains that cover enough of their template."""
        found, chains = [], {}

        def close(template: int) -> None:
            first, last, covered, _ = chains.pop(template)
            words, label = self.templates[template]
            if covered >= self.settings.min_coverage * len(words):
                found.append((label, first, last, covered / len(words)))

        for end, length, template, place in matches:
            start = end - length + 1
            chain = chains.get(template)
            if chain:
                fresh = min(length, place - chain[3], end - chain[1])  # words that go beyond the chain on both sides
                if fresh > 0 and start - chain[1] <= self.settings.max_gap:
                    chains[template] = (chain[0], end, chain[2] + fresh, place)
                    continue
                if fresh <= 0 and end <= chain[1]:
                    continue
                close(template)
            chains[template] = (start, end, length, place)
        for template in list(chains):
            close(template)
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


_SPAN = "struct<label:string,first_word:bigint,last_word:bigint,coverage:double>"
_RESULT = (f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
           f"score double, spans array<{_SPAN}>")


def _row(automaton: LicenseAutomaton, text: bytes | None) -> dict:
    words = words_of(text or b"")
    places, matches = automaton.scan(words, per_template=True)
    spans = automaton.spans(matches)
    starts = [p for p, _ in places]
    base = {label for _, label in places}
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
        "spans": [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans]}


def scan_licenses(docs: DataFrame, automaton: LicenseAutomaton | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A null text counts as empty: no words, no places (null), empty labels, score 0. ``score`` is the best coverage of a
    template; a phrase that stands in the text is a template covered in full. Rows are independent, so ties, repeated
    rows and null ids need no care; other columns of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton or LicenseAutomaton())
    kind = docs.schema[id_col].dataType.simpleString()
    plain = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                               ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [_row(known, text) for text in batch["body"].to_pylist()]
            columns = [pa.array([r[name] for r in rows], t) for name, t in [*plain, ("spans", span)]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns],
                                             names=["doc_id", *(n for n, _ in plain), "spans"])

    body = F.encode(F.col(text_col), "UTF-8").alias("body")
    return docs.select(F.col(id_col).alias("doc_id"), body).mapInArrow(run, f"doc_id {kind}, {_RESULT}")
