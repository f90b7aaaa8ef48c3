"""Hand rows for text rules, page orders, the cache, and the streams."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.config import CONFIG
from inkwell.functions import columns as C
from inkwell.operators import bookindex as I
from inkwell.operators import boxes as B
from inkwell.operators import search as S
from inkwell.operators import cache
from inkwell.sources.bridge import glyph_raster, rasters
from inkwell.streaming import pages as P


def line(*texts, gap=0.01):
    out, x = [], 0.0
    for t in texts:
        out.append((t, x, x + 0.1))
        x += 0.1 + gap
    return out


LINES = [
    (line("filtration, 23"), ["23"]),
    (line("45–47"), ["45"]),
    (line("102f, 110ff"), ["102", "110"]),
    (line("Euclidean 3-space, 12"), ["12"]),
    (line("Euclidean 3-space", "12", gap=0.05), ["12"]),
    (line("12", "beta, 30", gap=0.05), ["12"]),
    (line("23 (definition)"), ["23"]),
    (line("preface, xi, 5"), ["xi", "5"]),
    (line("007, 0, 8"), ["8"]),
    ([], []),
    (line("alpha, 3, x", "beta 12", gap=0.05), ["3", "x"]),
    (line("see x", ", 4, beta", "5", gap=0.05), ["5"]),
    (line("4 beta", "", "5", gap=0.05), ["4"]),
    (line("4 f, 6nn 8"), ["4", "6", "8"]),
    (line("c f, c"), ["c"]),
    (line("n, ii–v"), ["ii", "v"]),
]


def slow_refs(items):
    """Token by token: each reference with the stretch it lies in."""
    refs, stretch, open_, last, right = [], 0, False, "", None
    for text, left, end in items:
        if right is not None and left - right > CONFIG.index_max_gap and (any(s == stretch for s, _ in refs) or refs and not re.match(r"\s*\d", text)):
            break
        for tok in re.findall(I.TOKEN, text):
            number, roman = re.match("[1-9]", tok), re.match(I.ROMAN, tok)
            open_ = open_ or bool(number or roman and last == ",")
            if open_ and (number or roman):
                refs.append((stretch, re.match(r"\d+|.*", tok)[0]))
            if re.match("[A-Za-z]", tok) and not roman and not re.match(I.SUFFIX, tok):
                stretch, open_ = stretch + 1, False
            last = tok
        right = end
    return [r for s, r in refs if s == max(refs)[0]]


def test_refs_in_line(spark):
    rng = random.Random(3)
    pool = ["12", "45–47", "007", "xi", "c", "f", "nn", ",", "(", "beta", "Index", " ", "3-space", "é"]
    lines = [x for x, _ in LINES] + [line(*("".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(5))), gap=rng.choice([0.01, 0.05])) for _ in range(300)]
    assert [slow_refs(x) for x, _ in LINES] == [want for _, want in LINES]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, line array<struct<s:string,x:double,r:double>>")
    got = {n: [] for n in range(len(lines))}
    for r in sorted(I.line_refs(df, ["n"]).collect(), key=lambda r: (r.n, r.pos)):
        got[r.n].append(r.label)
    assert got == {n: slow_refs(x) for n, x in enumerate(lines)}


def test_index_titles(spark):
    good = ["Index", "Subject Index", "List of Symbols", "B. Notation", "Glossary", "Chapter 3. Index", "7. Table of notations"]
    bad = ["Index theorem", "The index of a map", "Indexing", None, ""]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", C.is_index_title(F.col("t")).alias("ok")).collect()
    assert [r.t for r in rows if r.ok] == good


def test_rank(spark):
    rows = spark.createDataFrame([(10, False), (9, False), (11, False), (8, False), (12, False), (50, True)], "p long, r boolean")
    assert [x.k for x in rows.select(C.page_rank(F.col("p"), F.lit(10), F.col("r")).alias("k")).collect()] == [0, 1, 2, 3, 4, -1]


@pytest.mark.parametrize("first, order", [([], [3, 2, 1, 4, 5]), ([5, 9, 5], [5, 3, 2, 1, 4])])
def test_scan_order(spark, first, order):
    pages = spark.createDataFrame([(1, n) for n in range(1, 6)], "doc_id long, page_number long")
    starts = spark.createDataFrame([(1, 3)], "doc_id long, start long")
    asked = spark.createDataFrame([(1, n, k) for k, n in enumerate(first)], "doc_id long, page_number long, pos long")
    got = I.scan_order(pages, starts, asked).orderBy("ord").collect()
    assert [r.page_number for r in got] == order


def test_upper_median(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>").select(C.upper_median(F.col("v")).alias("m")).collect()
    assert [r.m for r in rows] == [3.0, 0.0]


def test_reading_order_compares_with_the_first_centre(spark):
    rows = spark.createDataFrame([(1, 0, 5, 5, 4, 10), (1, 1, 0, 9, 4, 10), (1, 2, 9, 13, 4, 10)], "page long, ord long, x long, y long, w long, h long")
    got = {r.ord: (r.line, r.reading_ord) for r in B.reading_order(rows).collect()}
    assert got == {1: (1, 1), 0: (1, 2), 2: (2, 3)}


def test_rotated_boxes(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 90), (0.1, 0.2, 0.3, 0.4, 270)], "x double, y double, w double, h double, r int")
    rows = df.select(*(c.alias(n) for c, n in zip(C.rotate_box(*(F.col(c) for c in "xywhr")), "abcd"))).collect()
    assert np.allclose(rows[0], (0.4, 0.1, 0.4, 0.3)) and np.allclose(rows[1], (0.2, 0.6, 0.4, 0.3))


def test_compact_bytes(spark):
    row = spark.range(1).select(C.compact_bytes(F.lit(10), F.lit(4), F.lit(2), F.lit(1), F.lit(100)).alias("b")).first()
    assert row.b == 132


@pytest.mark.parametrize("cap", [400, 300, 200, 100, 0])
def test_retained_pages(spark, cap):
    """Reserved pages in their order up to the reserved share, then the others by distance, as far as all fit."""
    sizes = np.random.default_rng(1).integers(5, 40, 40).tolist()
    pages = spark.createDataFrame([(d, p, b) for d in (1, 2) for p, b in enumerate(sizes, 1)], "doc_id long, page_number long, bytes long")
    got = {r.page_number: (r.reserved, r.full) for r in cache.retained(pages, cap, 7, (30, 9, 31)).where("doc_id = 1").collect()}
    first, used = [], 0
    for p in (30, 9, 31):
        used += sizes[p - 1]
        if used <= CONFIG.index_reserved_share * cap:
            first.append(p)
    want, used = {}, 0
    for p in first + sorted((p for p in range(1, 41) if p not in first), key=lambda p: 2 * (p - 7) if p >= 7 else 2 * (7 - p) - 1):
        used += sizes[p - 1]
        if used > cap:
            break
        want[p] = (p in first, True)
    assert got == want


def test_broken_pages_do_not_stop_the_search(spark):
    texts = spark.createDataFrame([(1, "aaa"), (2, "bab")], "id long, t string")
    good = rasters(texts, "id", "t", True)
    broken = spark.createDataFrame([(3, 5, 5, bytearray(b"\0" * 7)), (4, 5, 5, None)], "page long, w int, h int, bits binary")
    every = good.unionByName(broken)
    t = S.template_from_region(glyph_raster("a"), 0, 0, 20, 28)
    assert {r.page for r in S.page_matches(every, t, 0.9).collect()} == {1, 2}
    report = {r.page: r.error is not None for r in S.scan_report(every).collect()}
    assert report == {1: False, 2: False, 3: True, 4: True}


def test_streamed_search_equals_the_batch(spark, tmp_path):
    texts = spark.createDataFrame([(k, "abca hbb" * (k + 1)) for k in range(4)], "id long, t string")
    images = rasters(texts, "id", "t", True)
    images.repartition(4, "page").write.parquet(f"{tmp_path}/in")
    t = S.template_from_region(glyph_raster("a"), 0, 0, 20, 28)
    P.run_search(P.page_stream(spark, f"{tmp_path}/in"), t, f"{tmp_path}/out", f"{tmp_path}/chk", threshold=0.6)
    key = ["page", "reading_ord", "x_norm", "y_norm", "score"]
    got = spark.read.parquet(f"{tmp_path}/out").select(key).orderBy(key).collect()
    assert got == S.page_matches(images, t, threshold=0.6).select(key).orderBy(key).collect()
