"""License scans: ordered signature rules, gated by keywords, with overlaps resolved by priority and containment.

A text is brought into the normal form of ``license_rules`` and searched once for the
heads of all rules by an Aho-Corasick automaton. At each head found, the rules that
begin with it are tried, so the regular expressions of a rule run only where its
keywords stand and never over a whole text. A detection is suppressed if it lies within
one of higher priority, within a longer one of its own priority, or on the very words
of an earlier rule of its own priority; so "gnu general public license version 3" hides
"gnu general public license". Base phrases are counted wherever they stand, and their
labels always stay.

``score`` is the weight of the surest detection that is kept; a base phrase counts as a
``name``.

Texts are scanned where they lie: nothing is shuffled, and a task holds one text at a
time in a few copies.

Defined cases: a null or empty text, or one without a word, has no word, no place and
no label, and a score of 0; characters from U+0080 on are parts of words, so a phrase
that is glued to one is not found; repeated rows and rows with a null id are scanned
each; texts of any length are scanned whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, KINDS, RULES, Rule

#: Bytes to the bytes of the normal form: other ASCII characters than letters and digits are blanks.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLANKS = re.compile(rb" {2,}")
DETECTION = "struct<label:string,kind:string,start:long,end:long,base:boolean,kept:boolean>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, detections array<{DETECTION}>, score double"
ROWS = 1024


def normal_form(text: bytes) -> bytes:
    """Words with one blank before, between and behind them; a single blank without words."""
    return BLANKS.sub(b" ", b" " + text.translate(NORMAL) + b" ")


@dataclass
class Scanner:
    """The rules by head, and the automaton of all heads."""

    rules: list[Rule]
    base: dict[str, str]

    def __post_init__(self):
        self.by_head: dict[str, list[tuple[int, re.Pattern | None]]] = {}
        for k, r in enumerate(self.rules):
            self.by_head.setdefault(r.head, []).append((k, re.compile(r.rest + "(?= )") if r.rest else None))
        for head in self.base:
            self.by_head.setdefault(head, [])
        self.automaton = ahocorasick.Automaton()
        for head in self.by_head:
            self.automaton.add_word(f" {head} ", head)
        self.automaton.make_automaton()

    def places(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
        """((start, end, rule) of each rule that matches, (start, end, phrase) of each base phrase), as places of the blanks around them."""
        found, base = [], []
        for last, head in self.automaton.iter(text):
            start = last - len(head) - 1
            if head in self.base:
                base.append((start, last, head))
            for k, rest in self.by_head[head]:
                m = rest.match(text, last) if rest else None
                if m or not rest:
                    found.append((start, m.end() if m else last, k))
        return found, base

    def kept(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Which of the detections, in order of (start, -end, priority, rule), no other one suppresses."""
        reach: dict[int, int] = {}  # the furthest end of each priority so far: what comes later begins no earlier
        out = []
        for _, end, k in found:
            mine = self.rules[k].priority
            out.append(not any(p <= mine and e >= end for p, e in reach.items()))
            reach[mine] = max(reach.get(mine, -1), end)
        return out

    def scan(self, raw: bytes | None) -> tuple:
        """A row of SCHEMA."""
        form = normal_form(raw or b"")
        n_words = form.count(b" ") - 1
        if n_words < 1:
            return 0, 0, None, None, [], 0.0
        found, base = self.places(form.decode("latin-1"))
        found = sorted(set(found), key=lambda d: (d[0], -d[1], self.rules[d[2]].priority, d[2]))
        stays = self.kept(found)
        word = counter(form)
        where = {at: word(at) for at in sorted({x for s, e, _ in [*found, *base] for x in (s, e)})}
        rows = [{"label": self.rules[k].label, "kind": self.rules[k].kind, "start": where[s], "end": where[e], "base": False, "kept": kept} for (s, e, k), kept in zip(found, stays)]
        rows += [{"label": self.base[p], "kind": "name", "start": where[s], "end": where[e], "base": True, "kept": True} for s, e, p in base]
        rows.sort(key=lambda r: (r["start"], -r["end"], not r["base"]))
        starts = [where[s] for s, _, _ in base]
        return n_words, len(base), min(starts, default=None), max(starts, default=None), rows, max((KINDS[r["kind"]][1] for r in rows if r["kept"]), default=0.0)


def counter(form: bytes):
    """A function that numbers the words behind ascending places of blanks, which reads the text once."""
    at = n = 0

    def word(place: int) -> int:
        nonlocal at, n
        n += form.count(b" ", at, place)
        at = place
        return n

    return word


@functools.cache
def scanner() -> Scanner:
    return Scanner(RULES, BASE)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    detection = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("kept", pa.bool_())])
    kinds = [pa.int64()] * 4 + [pa.list_(detection), pa.float64()]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        for i in range(0, batch.num_rows, ROWS):
            rows = [scanner().scan(text[k].as_py()) for k in range(i, min(i + ROWS, batch.num_rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["id", *names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, words, places of base phrases with the first and last word at which one begins, all ``detections`` (label, kind, first word, word behind the last, base, kept) in order, and the score."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_scan, f"id {dict(narrow.dtypes)['id']}, {SCHEMA}").withColumnRenamed("id", id_col)


def labels(detections: Column, base_only: bool = False) -> Column:
    """Distinct labels of what is kept, sorted, joined by commas."""
    some = F.filter(detections, lambda d: d["base"] if base_only else d["kept"])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scan with ``base_labels`` and ``labels`` in place of the detections."""
    found = scan_licenses(docs, id_col, text_col)
    return found.select(id_col, "n_words", "n_base", "first_word", "last_word", labels(F.col("detections"), True).alias("base_labels"), labels(F.col("detections")).alias("labels"), "score")
