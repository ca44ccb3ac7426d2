"""License scans by template markup.

A template is the wording of a license with marked regions:

* ``[[ ... ]]`` may be absent; it may hold further regions;
* ``{{name:from-to}}`` stands for any ``from`` to ``to`` words;
* ``{{name=a|b c}}`` stands for one of the given wordings.

All else is mandatory. A template is compiled into an automaton over words: states are places in
the wording, a word or "any word" leads on, optional regions are skipped by empty moves. A place of
a text accepts a template if a run from there reaches its end, so every mandatory word is there in
order. Runs begin only in texts with an anchor, the longest mandatory word of a template.

Beside the templates, plain phrases are counted: places where their words stand one after another.

Cases: null and empty texts have no words, no places, no labels and score 0. Overlapping places
count each; equal rows give equal results. Columns with the name of an added one are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.frames import map_arrow

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses, with the regions that may differ.
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0
        [[ (the "License"); you may not use this {{what:1-3}} except in compliance with the License
        [[. You may obtain a copy of the License at {{where:1-12}} ]] ]]""",
    "gpl-3.0": """[[This {{what:1-3}} is]] licensed under the [[terms of the]]
        GNU General Public License, version 3 [[ of the License, or (at your option) any later
        version]]""",
    "gpl-2.0": """[[This {{what:1-3}} is]] licensed under the [[terms of the]]
        GNU General Public License, version 2 [[ of the License, or (at your option) any later
        version]]""",
    "gpl-notice": """This program is free software [[: you can redistribute it and/or modify it]]
        under the terms of the GNU General Public License as published by the Free Software
        Foundation [[, either version {{number:1-2}} of the License, or (at your option) any later
        version]]""",
    "mit-notice": """{{how=released|licensed|distributed|available}} under the [[terms of the]]
        MIT License""",
    "mit": """[[MIT License]] [[Copyright (c) {{holder:1-12}}]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "isc": """[[ISC License]] [[Copyright (c) {{holder:1-12}}]]
        Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met""",
    "cc-by-nc": "licensed under [[a]] {{by=cc|creative commons}} BY-NC {{version:1-2}}",
    "cc-by-sa": "licensed under [[a]] {{by=cc|creative commons}} BY-SA {{version:1-2}}",
    "cc-by-4.0": "licensed under [[a]] {{by=cc|creative commons}} BY 4.0",
    "cc0": "{{by=cc0|creative commons zero}} 1.0 [[universal]]",
}

_ANY = ""  # the move on any word

SCAN = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("template_labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType())])


def wording(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                      re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """``moves[s]`` leads from a place by a word; ``skips[s]`` leads on without one."""

    label: str
    moves: list[dict[str, set[int]]] = field(default_factory=lambda: [{}])
    skips: list[set[int]] = field(default_factory=lambda: [set()])
    depth: list[int] = field(default_factory=lambda: [0])  # mandatory words before a place
    mandatory: list[str] = field(default_factory=list)
    end: int = 0

    def place(self, depth: int) -> int:
        self.moves.append({})
        self.skips.append(set())
        self.depth.append(depth)
        return len(self.moves) - 1

    def by_word(self, at: int, word: str, counted: bool) -> int:
        if counted:
            self.mandatory.append(word)
        to = self.place(self.depth[at] + counted)
        self.moves[at].setdefault(word, set()).add(to)
        return to

    def closure(self, places: set[int]) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for to in self.skips[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)


_REGION = re.compile(r"\[\[|\]\]|\{\{(\w+)(?::(\d+)-(\d+)|=([^}]*))\}\}")


def compile_template(label: str, text: str) -> Automaton:
    auto, at, done, begun = Automaton(label), 0, 0, []
    for m in [*_REGION.finditer(text), None]:
        for word in wording(text[done:m.start() if m else len(text)]):
            at = auto.by_word(at, word, not begun)
        if m is None:
            break
        done = m.end()
        if m[0] == "[[":
            begun.append(at)
        elif m[0] == "]]":
            # What follows a region starts at a place of its own, so no word can lead back in.
            to = auto.place(auto.depth[at])
            auto.skips[at].add(to)
            auto.skips[begun.pop()].add(to)
            at = to
        elif m[4] is not None:
            to = auto.place(auto.depth[at])
            for choice in m[4].split("|"):
                end = at
                for word in wording(choice):
                    end = auto.by_word(end, word, False)
                auto.skips[end].add(to)
            at = to
        else:
            to = auto.place(auto.depth[at])
            for k in range(int(m[3])):
                if k >= int(m[2]):
                    auto.skips[at].add(to)
                at = auto.by_word(at, _ANY, False)
            auto.skips[at].add(to)
            at = to
    auto.end = at
    return auto


class Matcher:
    """All automata, run together; sets of places are worked out once and then looked up."""

    def __init__(self, templates: dict[str, str]):
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.anchors = {max(a.mandatory, key=len) for a in self.automata}
        self.words = {w for a in self.automata for m in a.moves for w in m if w != _ANY}
        self.begins = [a.closure({0}) for a in self.automata]
        self.opening = [{w for s in b for w in a.moves[s]} - {_ANY}
                        for a, b in zip(self.automata, self.begins, strict=True)]
        self.starts = {w for o in self.opening for w in o}
        self.next: dict[tuple[int, frozenset[int], str], frozenset[int]] = {}

    def step(self, k: int, places: frozenset[int], word: str) -> frozenset[int]:
        key = (k, places, word if word in self.words else _ANY)
        if key not in self.next:
            auto, to = self.automata[k], set()
            for s in places:
                to |= auto.moves[s].get(word, set()) | auto.moves[s].get(_ANY, set())
            self.next[key] = auto.closure(to)
        return self.next[key]

    def run(self, word, at: int, end: int) -> list[tuple[str, bool, float]]:
        """What starts at word ``at``: label, accepted, share of the mandatory words passed."""
        first, out = word(at), []
        for k, auto in enumerate(self.automata):
            if first not in self.opening[k]:
                continue
            places, p, accepted, deep = self.begins[k], at, False, 0
            while places and p < end:
                places = self.step(k, places, word(p))
                p += 1
                accepted |= auto.end in places
                deep = max([deep, *(auto.depth[s] for s in places)])
            out.append((auto.label, accepted, deep / len(auto.mandatory)))
        return out


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(A.ByteRuns(data)(np.array([0]), np.array([len(data)]))[0])


def _phrase_places(words: A.Words, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """First word and label of every place of every phrase in a block."""
    out = []
    for phrase, label in phrases.items():
        parts = wording(phrase)
        at = np.arange(max(0, int(words.first[-1]) - len(parts) + 1))
        for k, part in enumerate(parts):
            at = at[words.hash[at + k] == np.uint64(_hash_of(part))]
        last = at + len(parts) - 1
        row = np.searchsorted(words.first, at, side="right")
        at = at[row == np.searchsorted(words.first, last, side="right")]
        out += [(int(k), label) for k in at if [words.text(int(k) + j).decode() for j in range(
            len(parts))] == parts]
    return sorted(out)


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` and the columns of ``SCAN``.

    ``score`` is 1 where a template is accepted, else the largest share of a template's mandatory
    words that a run passed in order, halved.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    kept: list[Matcher] = []

    def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not kept:
            kept.append(Matcher(templates))
        matcher = kept[0]
        anchors = np.array(sorted(map(_hash_of, matcher.anchors)), dtype=np.uint64)
        starts = np.array(sorted(map(_hash_of, matcher.starts)), dtype=np.uint64)
        n = batch.num_rows
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first: list = [None] * n
        last: list = [None] * n
        base: list = [set() for _ in range(n)]
        labels: list = [set() for _ in range(n)]
        score = np.zeros(n)
        for begin, to, words in A.block_words(batch.column(text), A.ALNUM):
            n_words[begin:to] = words.counts
            for k, label in _phrase_places(words, phrases):
                r = int(np.searchsorted(words.first, k, side="right")) - 1
                place = k - int(words.first[r])
                r += begin
                n_base[r] += 1
                first[r] = place if first[r] is None else min(first[r], place)
                last[r] = place if last[r] is None else max(last[r], place)
                base[r].add(label)
            if not len(words.hash) or not len(anchors):
                continue
            anchored = np.zeros(to - begin, dtype=bool)
            anchored[words.row[np.isin(words.hash, anchors)]] = True
            could = np.isin(words.hash, starts) & np.repeat(anchored, words.counts)
            for k in np.flatnonzero(could):
                r = int(np.searchsorted(words.first, k, side="right")) - 1
                for label, accepted, share in matcher.run(
                        lambda p: words.text(p).decode(), int(k), int(words.first[r + 1])):
                    if accepted:
                        labels[begin + r].add(label)
                    score[begin + r] = max(score[begin + r], 1.0 if accepted else share / 2)
        strings = pa.list_(pa.string())
        return {"n_words": pa.array(n_words), "n_base": pa.array(n_base),
                "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
                "base_labels": pa.array([sorted(x) for x in base], strings),
                "template_labels": pa.array([sorted(x) for x in labels], strings),
                "score": pa.array(score)}

    return map_arrow(docs, scan, SCAN)
