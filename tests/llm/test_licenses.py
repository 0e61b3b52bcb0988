import re

from tidemark.llm import licenses as l
from tidemark.llm.queries import op4_license_scan

SCHEMA = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    first = [i for i, _ in places]
    return len(w), len(places), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in places}))


def check(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op4_license_scan(spark, str(path)).collect()), key=str)
    assert got == sorted([(d, *brute(t)) for d, t in rows], key=str)


def test_against_brute_force(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, tmp_path)


def test_edges(spark, tmp_path):
    rows = [
        (1, None),
        (2, ""),
        (None, "MIT License, mit-license; the GNU General\nPublic License"),
        (4, "x " * 5000 + "APACHE license"),
        (4, "mit licenseé mit  license"),
        (5, "general general public license license"),
        (5, "general general public license license"),
    ]
    check(spark, rows, tmp_path / "a")
    check(spark, [], tmp_path / "b")


def labels(text):
    base, found, score = l.Scanner().scan(text.encode())
    return {x for *_, x in base}, {x for *_, x in found}, score


def test_templates():
    grant = l._GRANT.replace("<<opt>> including the next paragraph <</opt>>", "")
    assert labels(f"Copyright 2020 A. {grant}") == (set(), {"mit-text"}, 1.0)
    assert labels(l._GRANT.replace("<<opt>>", "(").replace("<</opt>>", ")"))[1] == {"mit-text"}
    almost = labels(grant.replace("sublicense", "relicense"))
    assert almost[1] == set() and 0.3 < almost[2] < 1
    assert labels("Licensed under the Apache License, Version 2.0.") == ({"apache"}, {"apache-2.0"}, 1.0)
    assert labels("licensed under the terms of the GNU General Public License, version 3.") == ({"gpl"}, {"gpl-3.0"}, 1.0)
    assert labels("Licensed under CC BY-NC 4.0.")[1] == {"cc-by-nc-4.0"}
    assert labels("Released under the MIT License.") == ({"mit"}, {"mit-notice"}, 1.0)
    assert labels("a plain text") == (set(), set(), 0.0)


def test_automaton_regions():
    a = l.Automaton.compile("a <<opt>> b <<opt>> c <</opt>> <</opt>> d <<var 2>> e", "x")
    run = lambda s: a.run(s.encode().split(), 0)[0]
    assert [run(s) for s in ("a d e", "a b d e", "a b c d e", "a d q e", "a d q r e", "a c d e", "a d q r s e", "a b", "d e")] == [3, 4, 5, 4, 5, None, None, None, None]


def test_places_of_templates(spark):
    df = spark.createDataFrame([(1, "x Released under the MIT License. y", 3)], "doc_id long, text string, base int")
    row = l.scan(df).first()
    assert [tuple(x) for x in row.base] == [(4, 6, "mit")] and [tuple(x) for x in row.found] == [(1, 6, "mit-notice")]


class Plain:
    """Templates as regular expressions over words, tried at every place of every text, without any prefilter."""

    def __init__(self, template):
        self.parts = [x.split() for x in re.sub(r"<<opt>>.*?<</opt>>|<<var \d+>>", "|", template).split("|")]
        self.mandatory = sum(self.parts, [])
        mark = {"<<opt>>": "(?:", "<</opt>>": ")?"}
        pattern, i, tokens = "", 0, re.findall(r"<<var \d+>>|\S+", template)
        while i < len(tokens):
            t = tokens[i]
            pattern += mark[t] if t in mark else rf"(?:\S+ ){{0,{t[6:-2]}}}" if t.startswith("<<var") else re.escape(t) + " "
            i += 1
        self.pattern = re.compile(pattern)


def share(template, words, i):
    """The most mandatory words passed from place i on, by walking all ways through the template."""
    tokens = re.findall(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<]+", template)
    close = {}
    stack = []
    for k, t in enumerate(tokens):
        if t == "<<opt>>":
            stack.append(k)
        elif t == "<</opt>>":
            close[stack.pop()] = k
    inside = [0] * len(tokens)
    for a, b in close.items():
        for k in range(a, b):
            inside[k] = 1
    best, seen, todo = 0, set(), [(0, i, 0)]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        k, at, passed = state
        best = max(best, passed)
        if k == len(tokens):
            continue
        t = tokens[k]
        if t == "<<opt>>":
            todo += [(k + 1, at, passed), (close[k] + 1, at, passed)]
        elif t == "<</opt>>":
            todo.append((k + 1, at, passed))
        elif t.startswith("<<var"):
            todo += [(k + 1, at + n, passed) for n in range(int(t[6:-2]) + 1) if at + n <= len(words)]
        elif at < len(words) and words[at] == t:
            todo.append((k + 1, at + 1, passed + (not inside[k])))
    return best


def test_scores_equal_all_templates_tried_at_all_places(spark, sf_dir, tmp_path):
    """Labels and scores of whole documents and of torn wordings, without heads, anchors or automata."""
    import random

    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [t for t in texts if t and re.search("licen[sc]e|permission|redistribution|spdx|released", t.lower())][:40]
    plain = re.compile(r"<</?opt>>|<<var \d+>>")
    for template, _ in l.TEMPLATES:
        words = plain.sub(" ", template).split()
        cut = rng.randrange(1, len(words))
        texts += [" ".join(words[:cut]), "A. " + " ".join(words), " ".join(words[:cut] + ["zzz"] + words[cut:])]
    texts.append("permission is hereby granted free of charge to any person obtaining a copy of this software and associated")
    scanner = l.Scanner()
    every = l.BASE + l.TEMPLATES
    size = {t: len(Plain(t).mandatory) for t, _ in every}
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
        score, found = 0.0, set()
        for template, label in every:
            pattern = Plain(template).pattern
            for i in range(len(words)):
                score = max(score, share(template, words, i) / size[template])
                if pattern.match(" ".join(words[i:]) + " "):
                    found.add(label)
        base, more, got = scanner.scan(text.encode())
        assert abs(got - score) < 1e-12 and {x for *_, x in base + more} == found, text


def test_more_wordings():
    assert labels("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3")[1] == {"agpl-3.0"}
    assert labels("licensed under the GNU Lesser General Public License, version 2.1")[1] == {"lgpl-2.1"}
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later")[1] == {"gpl-3.0"}
