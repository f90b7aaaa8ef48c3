"""License scans against a plain double, single rules, and odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm import licenses, queries
from inkwell.llm.license_rules import BASE, KINDS, RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def double(text):
    """(words, base places, first, last, base labels, labels, score): every rule tried at every word."""
    words = WORD.findall(lower(text or ""))
    joined, starts, at = " ".join(words) + " ", [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    number = {s: k for k, s in enumerate(starts)}
    base, found = [], []
    for phrase, label in BASE.items():
        own = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    for k, r in enumerate(RULES):
        whole = re.compile(re.escape(r.head) + r.rest + "(?= )")
        for m in re.finditer(f"(?={re.escape(r.head)} )", joined):
            if m.start() in number and (hit := whole.match(joined, m.start())):
                found.append((hit.start(), hit.end(), k))
    kept = []
    for s, e, k in found:
        def hides(o, s=s, e=e, k=k):
            if o[0] > s or o[1] < e or o == (s, e, k):
                return False
            p, q = RULES[o[2]].priority, RULES[k].priority
            return p < q or p == q and ((o[0], o[1]) != (s, e) or o[2] < k)
        if not any(map(hides, found)):
            kept.append(RULES[k])
    base_labels = {x for _, x in base}
    score = max([r.weight for r in kept] + [KINDS["name"][1]] * bool(base), default=0.0)
    first = [k for k, _ in base]
    return len(words), len(base), min(first, default=None), max(first, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {r.label for r in kept})), score


def row(text):
    n, b, first, last, found, score = licenses.scanner().scan(None if text is None else text.encode())
    names = lambda some: ",".join(sorted({d["label"] for d in found if some(d)}))
    return n, b, first, last, names(lambda d: d["base"]), names(lambda d: d["kept"]), score


def sample(r, rng):
    """A text that the rule should match."""
    rest = r.rest
    for cls, one in (("[^ ]+", "some"), ("[0-9]+", "3"), ("[1-4]", "4"), ("[05]", "0")):
        rest = rest.replace(cls, one)
    while "(" in rest:  # the innermost groups first
        rest = re.sub(r"\(\?:([^()]*)\)(\?|\*|\{[0-9]+,[0-9]+\}|)", lambda m: "" if m[2] in ("?", "*") and rng.random() < 0.5 else rng.choice(m[1].split("|")), rest)
    return r.head + rest


def test_hundreds_of_rules():
    assert len(RULES) > 300 and len({r.label for r in RULES}) > 150
    for r in RULES:
        assert r.kind in KINDS and re.fullmatch(r"[0-9a-z]+( [0-9a-z]+)*", r.head)


@pytest.mark.parametrize("text, want", [
    ("This work is licensed under the GNU General Public License, version 3.", ("gpl", "gpl,gpl-3.0")),
    ("Released under the MIT License.", ("mit", "mit")),
    ("Licensed under CC BY-NC 4.0.", ("cc-by", "cc-by,cc-by-nc-4.0")),
    ("Licensed under the Apache License, Version 2.0.", ("apache", "apache,apache-2.0")),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ("", "gpl-2.0-or-later")),
    ("# Redistribution and use in source and binary forms,\n# with or without modification, are permitted provided that\n# the following conditions are met:", ("", "bsd")),
    ("the GNU Lesser General Public License v2.1", ("", "lgpl-2.1")),
    ("ccby mit licenses apache-licensed", ("", "")),
    ("Mozilla Public License, v. 2.0 and BSD-3-Clause license", ("", "bsd-3-clause,mpl-2.0")),
])
def test_labels(text, want):
    assert row(text)[4:6] == want


def test_every_rule_matches_its_sample():
    rng = random.Random(1)
    for k, r in enumerate(RULES):
        for _ in range(4):
            text = f" x {sample(r, rng)} y "
            found, _ = licenses.scanner().places(text)
            assert any(d[2] == k for d in found), (r, text)


def test_scan_equals_double():
    rng = random.Random(7)
    noise = "license the under gnu general public mit cc by nc sa 4 0 2 version v apache é software lesser 3 or later".split()
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(sample(rng.choice(RULES), rng) if rng.random() < 0.4 else rng.choice(noise))
            if rng.random() < 0.2:
                parts.append(rng.choice([*BASE, "MIT", "Ä", "\n\n", "—", "\x00"]))
        text = rng.choice([" ", ", ", "-", " \n* "]).join(parts)
        text = text.upper() if rng.random() < 0.2 and text.isascii() else text
        assert row(text) == double(text), text


def test_base_places_share_words():
    assert row("cc by cc by mit license apache license apache license")[:4] == (10, 5, 0, 8)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n.,;"), (4, "mit license"), (4, "mit license"), (None, "mit license"), (5, "x " * 500_000 + "CC BY-SA 4.0"), (6, "é" * 10), (7, "mit licenseé")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "labels", "score", "detections", "n_words")})
    got = sorted((tuple(r) for r in licenses.license_report(df).collect()), key=str)
    assert got == sorted(((i, *double(t)) for i, t in rows), key=str)
    assert licenses.license_report(df.where("false")).collect() == []


def test_long_texts_of_keywords():
    """A megabyte of heads and of near misses takes no more than linear time."""
    for text in ("mit license " * 90_000, "neither the name of " * 50_000, "gnu general public license version " * 30_000, "a" * 1_000_000):
        n, b, *_ = row(text)
        assert n == len(text.split()) and b == text.count("mit license") + text.count("gnu general public license")


def test_query_equals_double(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op11_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert tuple(r)[1:] == double(docs[r.doc_id])
