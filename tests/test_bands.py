"""Joins by cells and bands against all pairs, and how many rows they compare."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.config import CONFIG
from inkwell.functions import kernels as K
from inkwell.operators import bookindex as I
from inkwell.operators import boxes as B
from inkwell.operators import textlayer as T


def slow_attached(windows, comps):
    """All pairs, by the page kernel for one window at a time, without the shape test of commas."""
    out = set()
    for page, o, x, y, w, h in windows:
        for p, c, x0, y0, x1, y1 in comps:
            if p != page or c == o:
                continue
            cfg, right, bottom, ch, cw = CONFIG, x + w, y + h - 1, y1 - y0 + 1, x1 - x0 + 1
            near = right - 1 <= x0 <= right + cfg.script_max_gap * h and cfg.script_min_height * h <= ch <= cfg.script_max_height * h
            sub = near and y0 <= bottom - cfg.script_min_overlap * h and y1 >= bottom + cfg.script_min_offset * h
            sup = near and y1 >= y + cfg.script_min_overlap * h and y0 <= y - cfg.script_min_offset * h
            over = x0 < right and x1 >= x and x0 >= x - cfg.accent_max_width * w and ch <= cfg.accent_max_height * h and cw <= cfg.accent_max_width * w
            over = over and min(x1, right - 1) - max(x0, x) + 1 >= cfg.accent_min_overlap * cw and not (ch <= cfg.rule_max_thickness_px and cw >= cfg.rule_min_width * w)
            gap = cfg.accent_max_gap * h
            over = over and (y1 < y and y - y1 - 1 <= gap or y0 > bottom and y0 - bottom - 1 <= gap)
            if sub or sup or over:
                out.add((page, o, c, "both" if sub and sup else "sub" if sub else "super" if sup else None, over))
    return out


def frames(spark, windows, comps):
    w = spark.createDataFrame(windows, "page long, ord long, x long, y long, w long, h long")
    c = spark.createDataFrame(comps, "page long, ord long, x long, y long, x1 long, y1 long")
    return w, c


@pytest.mark.parametrize("side", [1, 7, 32, 1000])
def test_attached_pairs_equal_all_pairs(spark, side):
    rng = random.Random(side)
    windows = [(rng.randrange(2), k, rng.randrange(-20, 200), rng.randrange(-20, 150), rng.choice([1, 2, 9, 30, 80]), rng.choice([1, 3, 12, 40, 90])) for k in range(120)]
    comps = []
    for k in range(300):  # many of them beside windows
        p, _, x, y, w, h = rng.choice(windows)
        x0, y0 = rng.choice([x + w + rng.randrange(-2, 6), x + rng.randrange(-3, w + 3)]), rng.choice([y + h + rng.randrange(-6, 6), y - rng.randrange(0, 12), y - h // 2])
        comps.append((p, 1000 + k, x0, y0, x0 + rng.randrange(0, w + 2), y0 + rng.randrange(0, max(h // 2, 1) + 2)))
    w, c = frames(spark, windows, comps)
    got = {tuple(r) for r in B.attached_pairs(w, c, side).select("page", "ord", "comp", "script", F.coalesce("accent", F.lit(False))).collect()}
    assert got == slow_attached(windows, comps) and {r[3] for r in got} >= {"sub", "super", None} and any(r[4] for r in got)


def output_rows(df):
    """Rows that each join of the executed plan gave."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        stack += [kids.apply(k) for k in range(kids.size())]
    return found


def test_a_dense_page_compares_neighbours_only(spark):
    """Of 4 million pairs of one page the join gives those that match; what shares a cell is a small multiple of the page."""
    comps = [(1, k, k % 50 * 30, k // 50 * 40, k % 50 * 30 + 14, k // 50 * 40 + 20) for k in range(2000)]
    comps += [(1, 5000 + k, k % 50 * 30 + 16, k // 50 * 40 + 14, k % 50 * 30 + 20, k // 50 * 40 + 26) for k in range(2000)]
    windows = [(1, k, x, y, 15, 21) for _, k, x, y, _, _ in comps[:2000]]
    w, c = frames(spark, windows, comps)
    pairs = B.attached_pairs(w, c)
    n = pairs.count()
    assert n == 2000 and output_rows(pairs) == [n]
    cells = lambda v: F.floor(F.col(v) / B.CELL_PX)
    per_cell = c.groupBy("page", cells("x"), cells("y")).count().agg(F.max("count")).first()[0]
    assert per_cell <= 8  # and a window of 15 x 21 reaches at most 12 cells


def slow_lines_beside(hits, items):
    out = {}
    for doc, page, hit, x, y, w, h in hits:
        mine = [(ix, o, s, ix + iw, ih, iy + ih / 2) for d, p, o, s, ix, iy, iw, ih in items if (d, p) == (doc, page)]
        tol = CONFIG.index_line_tolerance * h
        line = sorted(m for m in mine if y - tol <= m[5] <= y + h + tol and m[0] >= x + w - tol)
        high = sorted(m[4] for m in line)
        med = high[len(high) // 2] if high else 0.0
        size, mid = med or h / 0.7, y + h / 2
        out[doc, page, hit] = (line, sorted(m for m in mine if m[0] >= x and mid + 0.6 * size <= m[5] <= mid + 1.6 * size))
    return out


def test_lines_beside_hits_equal_all_pairs(spark):
    rng = random.Random(6)
    items = [(d, p, o, rng.choice(["a", "b, 3", "", "12"]), rng.random(), rng.uniform(-0.05, 1.02), rng.random() / 5, rng.choice([0.0, 0.01, 0.02, 0.3])) for d in (1, 2) for p in (1, 2) for o in range(60)]
    hits = [(rng.choice([1, 2, 3]), rng.choice([1, 2]), k, rng.random() / 2, rng.random(), rng.random() / 10, rng.choice([0.01, 0.03, 0.2, 0.9])) for k in range(60)]
    h = spark.createDataFrame(hits, "doc_id long, page_number long, hit long, x double, y double, w double, h double")
    i = spark.createDataFrame(items, "doc_id long, page_number long, item_ord long, str string, x double, y double, w double, h double")
    got = {(r.doc_id, r.page_number, r.hit): ([tuple(t) for t in r.line], [tuple(t) for t in r.below]) for r in I.line_items(h, i).collect()}
    assert got == slow_lines_beside(hits, items) and sum(bool(a) for a, _ in got.values()) > 10 and sum(bool(b) for _, b in got.values()) > 10


def test_lines_of_a_page_fold_in_one_pass(spark):
    y = np.array([0.1, 0.104, 0.1059, 0.107, 0.2, 0.21])
    assert T.fold_lines(y, 0.006).tolist() == [0, 0, 0, 1, 2, 3] and T.fold_lines(np.zeros(0), 1.0).tolist() == []
    n = 20_000  # on one page
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").alias("item_ord"), F.concat(F.lit("w"), "id").alias("str"), (F.col("id") % 10 / 10).alias("x"), (0.1 + F.floor(F.col("id") / 10) / 2500).alias("y"), F.lit(0.01).alias("w"), F.lit(0.0004).alias("h"))
    lines = T.page_lines(items).first().lines
    assert len(lines) == 2000 and lines[3] == " ".join(f"w{k}" for k in range(30, 40))


def test_kernel_and_join_agree(spark):
    """The search's kernel and the join of tables find the same attached components, commas apart."""
    rng = np.random.default_rng(9)
    image = (rng.random((120, 160)) < 0.06).astype(np.uint8)
    _, boxes, groups = K.analyse(image)
    page = K.Page(image, boxes, groups)
    ox, oy = rng.integers(0, 140, 40), rng.integers(0, 100, 40)
    commas = {c: K.is_comma(image, boxes[c]) for c in range(len(boxes))}
    p, comp = K.attached(page, ox, oy, 12, 16, {})
    windows = [(1, 10_000 + k, int(x), int(y), 12, 16) for k, (x, y) in enumerate(zip(ox, oy))]
    comps = [(1, k, *map(int, b[:4])) for k, b in enumerate(boxes)]
    w, c = frames(spark, windows, comps)
    got = {(r.ord - 10_000, r.comp) for r in B.attached_pairs(w, c).collect() if r.accent or r.script != "sub" or not commas[r.comp]}
    assert got == set(zip(p.tolist(), comp.tolist())) and got
