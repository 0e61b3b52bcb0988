"""License scans by template-markup matching.

A template is its wording with regions marked: <<opt>> .. <</opt>> may be left out, <<var N>> stands
for any words, N at most. Each is compiled to an automaton over words; a place of a text is accepted
if the automaton, started there, reaches its end with every mandatory word equal and in order. Case,
punctuation and line breaks don't count, as words are compared.

Every text is tokenised whole and counted. An automaton starts wherever one of its possible first words
stands, so a text that holds none of all templates' first words, not even inside a word, can begin
no wording: it is passed over, and scores 0 as it would otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Fixed phrases of the base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose <<opt>> and <</opt>> <<opt>> title and <</opt>> <<opt>> noninfringement <</opt>>"
)
_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or "
    "substantial portions of the software"
)
_FORMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer <<opt>> 2 <</opt>> redistributions in binary form must reproduce "
    "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution"
)
_NO_ENDORSEMENT = (
    "<<opt>> 3 <</opt>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission"
)
_DISCLAIMER = (
    "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties "
    "of merchantability and fitness for a particular purpose are disclaimed"
)
_UNDER = "licensed under <<opt>> the terms of <</opt>> <<opt>> a <</opt>> <<opt>> the <</opt>>"
_GNU = f"{_UNDER} <<opt>> gnu <</opt>> <<opt>> KIND <</opt>> general public license <<opt>> as published by the free software foundation <</opt>> <<opt>> either <</opt>> version"
_FREE = (
    "this <<var 4>> is free software you can redistribute it and or modify it under the terms of the gnu KIND general public license "
    "as published by the free software foundation <<opt>> either <</opt>> version"
)


def _gnu(form: str, kind: str) -> str:
    """The form for the general license, or for one whose kind must be named."""
    return form.replace("<<opt>> KIND <</opt>> ", f"{kind} " if kind else "").replace("KIND ", f"{kind} " if kind else "")


#: (template, label): full texts, notices and identifiers.
TEMPLATES = (
    (_GRANT, "mit-text"),
    (f"{_GRANT} {_AS_IS}", "mit-text-with-warranty"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "<<opt>> provided that the above copyright notice and this permission notice appear in all copies <</opt>>",
        "isc-text",
    ),
    (_FORMS, "bsd-2-clause-text"),
    (f"{_FORMS} {_NO_ENDORSEMENT}", "bsd-3-clause-text"),
    (_DISCLAIMER, "bsd-disclaimer"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at <<var 8>> unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0-header",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
        "mpl-2.0-header",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense-text",
    ),
    ("do what the fuck you want to public license", "wtfpl"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("released under <<opt>> the terms of <</opt>> <<opt>> the <</opt>> mit license", "mit-notice"),
    (f"{_UNDER} mit license", "mit-notice"),
    (f"{_UNDER} <<opt>> 2 clause <</opt>> <<opt>> 3 clause <</opt>> bsd license", "bsd-notice"),
    (f"{_UNDER} isc license", "isc-notice"),
    (f"{_UNDER} mozilla public license <<opt>> version <</opt>> <<opt>> v <</opt>> 2 0", "mpl-2.0"),
    (f"{_UNDER} apache license <<opt>> version <</opt>> 2 0", "apache-2.0"),
    *((f"{_gnu(form, kind)} {v}", f"{short}-{v}.0") for form in (_GNU, _FREE) for kind, short in (("", "gpl"), ("affero", "agpl")) for v in ("2", "3")),
    *((f"{_gnu(form, 'lesser')} {v}", f"lgpl-{v.replace(' ', '.')}") for form in (_GNU, _FREE) for v in ("2 1", "3")),
    (f"{_UNDER} cc by 4 0", "cc-by-4.0"),
    (f"{_UNDER} cc by sa 4 0", "cc-by-sa-4.0"),
    (f"{_UNDER} cc by nc 4 0", "cc-by-nc-4.0"),
    (f"{_UNDER} creative commons attribution 4 0 <<opt>> international <</opt>> <<opt>> public <</opt>> license", "cc-by-4.0"),
    (f"{_UNDER} creative commons attribution sharealike 4 0 <<opt>> international <</opt>> <<opt>> public <</opt>> license", "cc-by-sa-4.0"),
    (f"{_UNDER} creative commons attribution noncommercial 4 0 <<opt>> international <</opt>> <<opt>> public <</opt>> license", "cc-by-nc-4.0"),
    ("spdx license identifier mit", "mit-notice"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier bsd 2 clause", "bsd-2-clause"),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause"),
    ("spdx license identifier isc", "isc-notice"),
    ("spdx license identifier mpl 2 0", "mpl-2.0"),
    *((f"spdx license identifier {name} {v} 0 <<opt>> only <</opt>> <<opt>> or later <</opt>>", f"{name}-{v}.0") for name in ("gpl", "agpl", "lgpl") for v in ("2", "3")),
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var (\d+)>>|[^\s<]+")


@dataclass
class Automaton:
    """States are numbers; 0 is the start."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])  # by word
    skips: list[list[int]] = field(default_factory=lambda: [[]])  # without a word
    wild: list[int | None] = field(default_factory=lambda: [None])  # by any word
    depth: list[int] = field(default_factory=lambda: [0])  # mandatory words passed at least
    mandatory: list[bytes] = field(default_factory=list)
    end: int = 0

    @staticmethod
    def compile(template: str, label: str) -> Automaton:
        out, opened, at = Automaton(label), [], 0
        for mark in _MARK.finditer(template):
            token = mark.group(0)
            if token == "<<opt>>":
                opened.append(at)
            elif token == "<</opt>>":
                # Left empty: on to a fresh state, so that what follows can't re-enter the region.
                after = out._new(out.depth[opened[-1]])
                out.skips[at].append(after)
                out.skips[opened.pop()].append(after)
                at = after
            elif mark.group(1):
                after = None
                chain = [at] + [out._new(out.depth[at]) for _ in range(int(mark.group(1)))]
                after = out._new(out.depth[at])
                for a, b in zip(chain, chain[1:], strict=False):
                    out.wild[a] = b
                for a in chain:
                    out.skips[a].append(after)
                at = after
            else:
                word = token.encode()
                if not opened:
                    out.mandatory.append(word)
                after = out._new(out.depth[at] + (not opened))
                out.steps[at][word] = after
                at = after
        if opened or not out.mandatory:
            raise ValueError(f"template of {label}: an open region, or no mandatory word")
        out.end = at
        return out

    def _new(self, depth: int) -> int:
        self.steps.append({})
        self.skips.append([])
        self.wild.append(None)
        self.depth.append(depth)
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    @property
    def heads(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.steps[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """End of the longest accepted run of words from here, and how many mandatory words were passed."""
        states, end, most = self.closure({0}), None, 0
        while states:
            if self.end in states:
                end = at
            most = max(most, max(self.depth[s] for s in states))
            if at == len(words):
                break
            word = words[at]
            at += 1
            states = self.closure({t for s in states for t in (self.steps[s].get(word), self.wild[s]) if t is not None})
        return end, most


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [Automaton.compile(t, label) for t, label in base]
        self.more = [Automaton.compile(t, label) for t, label in templates]
        self.by_head: dict[bytes, list[tuple[bool, Automaton]]] = {}
        for is_base, group in ((True, self.base), (False, self.more)):
            for a in group:
                for head in a.heads:
                    self.by_head.setdefault(head, []).append((is_base, a))
        # Heads that hold no other head: a text with any head in it has one of these in it.
        self.anchors = [h for h in self.by_head if not any(other in h for other in self.by_head if other != h)]

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], float]:
        """Base places, template places (first word, end, label), and the largest share of a template's wording."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return [], [], 0.0
        words = _WORD.findall(low)
        base, more, score = [], [], 0.0
        for i, word in enumerate(words):
            for is_base, automaton in self.by_head.get(word, ()):
                end, passed = automaton.run(words, i)
                score = max(score, 1.0 if end is not None else passed / len(automaton.mandatory))
                if end is not None:
                    (base if is_base else more).append((i, end, automaton.label))
        return base, more, score


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """What licenses each document names.

    Returns a row for each input row: doc_id, n_words, base and found (places: first word, end,
    label, of the base phrases and of the templates), and score, the largest share of a base phrase's
    or template's mandatory words found in order from one place (1: accepted).

    Null and empty texts have no words, no places and score 0. Places may overlap; a phrase that
    repeats counts each time. Rows that repeat are scanned alike; an empty table gives an empty
    result; texts are taken whole and other columns ignored.
    """
    c.short_batches(docs.sparkSession)
    rows = c.pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    scanner = Scanner(base, templates)
    place = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    def run(batches):
        for batch in batches:
            data, at = c.arrow_bytes(batch.column("text"))
            *_, first = c.word_spans(data, at, c.ALNUM)
            found = [scanner.scan(x or b"") for x in batch.column("text").to_pylist()]
            named = [[[{"first": a, "end": b, "label": x} for a, b, x in f[k]] for f in found] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), *(pa.array(x, pa.list_(place)) for x in named), pa.array([f[2] for f in found], pa.float64())],
                names=["doc_id", "n_words", "base", "found", "score"],
            )

    kind = "array<struct<first: long, end: long, label: string>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, base {kind}, found {kind}, score double")
