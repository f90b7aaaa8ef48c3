"""The search, the index lookup and the first jump against doubles made by hand, page by page."""

import compare
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_lookup import slow_refs

from inkwell.config import CONFIG
from inkwell.functions import kernels as K
from inkwell.operators import raster
from inkwell.operators import search as S
from inkwell.plans import QUERIES
from inkwell.plans.raster_queries import images, symbol

D = str(compare.DATA)
FIELDS = ("x_norm", "y_norm", "w_norm", "h_norm", "score")


def iou(a, b):
    both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def slow_page(image, template, threshold):
    """Matches of one page in reading order: every pair of boxes is held against each other."""
    rows = K.match_page(template, K.Page(image, *K.analyse(image)[1:]), threshold)
    kept = []
    for r in sorted(rows.tolist(), key=lambda r: -r[4]):
        if all(iou(r, k) <= CONFIG.dedupe_iou for k in kept):
            kept.append(r)
    lines = []
    for r in sorted(kept, key=lambda r: r[1] + r[3] / 2):
        c = r[1] + r[3] / 2
        if lines and abs(c - lines[-1][0]) <= 0.5 * min(r[3], lines[-1][1]):
            lines[-1][1] = max(lines[-1][1], r[3])
            lines[-1][2].append(r)
        else:
            lines.append([c, r[3], [r]])
    h, w = image.shape
    return [(r[0] / w, r[1] / h, r[2] / w, r[3] / h, r[4]) for line in lines for r in sorted(line[2], key=lambda r: r[0])]


@pytest.fixture(scope="module")
def found(spark):
    return {r.page: slow_page(np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w), symbol(1), CONFIG.search_floor) for r in images(spark, D, glyphs=True).collect()}


@pytest.fixture(scope="module")
def book():
    """Pages of documents of four, and which of them is the last."""
    pages = {i: (i // 4, i % 4 + 1) for i in pq.read_table(f"{D}/benchmark.parquet").column("item_id").to_pylist()}
    total = {}
    for doc, n in pages.values():
        total[doc] = max(total.get(doc, 0), n)
    return pages, total


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_page_matches(spark, found):
    want = [(page, k, *m) for page, ms in found.items() for k, m in enumerate(ms, 1)]
    assert rows(QUERIES["r2_page_matches"](spark, D), "page", "reading_ord", *FIELDS) == sorted(want) and want


def slow_references(found, book):
    """Labels beside, or else below, the hits on each document's index page, with the page they name."""
    pages, total = book
    out = set()
    for page, (doc, n) in pages.items():
        if n != total[doc]:
            continue
        items = [(0.1, 0.05, 0.2, 0.02, "Index"), (0.99, 0.02, 0.005, 0.9, f"term, {doc % 3 + 1}"), (0.5, 0.95, 0.02, 0.02, str(n))]
        for x, y, w, h, score in found[page]:
            if score < CONFIG.similarity_threshold:
                continue
            tol = 0.35 * h
            line = sorted(i for i in items if y - tol <= i[1] + i[3] / 2 <= y + h + tol and i[0] >= x + w - tol)
            high = sorted(i[3] for i in line)
            size = high[len(high) // 2] if line else h / 0.7
            below = sorted(i for i in items if i[0] >= x and y + h / 2 + 0.6 * size <= i[1] + i[3] / 2 <= y + h / 2 + 1.6 * size)
            read = lambda part: slow_refs([(i[4], i[0], i[0] + i[2]) for i in part])
            out |= {(doc, label, int(label), True) for label in read(line) or read(below) if int(label) <= total[doc]}
    return out


def test_index_lookup(spark, found, book):
    assert rows(QUERIES["r4_look_up_index"](spark, D), "doc_id", "label", "page_number", "exact") == sorted(slow_references(found, book))


def scan(start, total, first):
    first = sorted(set(first))
    return first + [n for n in [*range(start, 0, -1), *range(start + 1, total + 1)] if n not in first]


def test_search_in_the_order_of_references(spark, found, book):
    pages, total = book
    refs = slow_references(found, book)
    want = []
    for page, (doc, n) in pages.items():
        named = [p for d, _, p, _ in refs if d == doc]
        place = scan(min(named, default=1), total[doc], named).index(n) + 1
        if n != total[doc]:  # index pages were searched for the lookup
            want += [(doc, n, place, k, *m) for k, m in enumerate(found[page], 1)]
    assert rows(QUERIES["r6_search"](spark, D), "doc_id", "page_number", "scan_ord", "reading_ord", *FIELDS) == sorted(want) and want


def test_first_jump(spark, found, book):
    pages, total = book
    at = {v: k for k, v in pages.items()}
    want = []
    for doc in total:
        shown = [(n, k, m[4]) for n in scan(total[doc], total[doc], []) for k, m in enumerate(found[at[doc, n]], 1) if m[4] >= CONFIG.similarity_threshold]
        want += [(doc, *s) for s in shown[:1]]
    assert rows(QUERIES["l9_first_jump"](spark, D), "doc_id", "page_number", "reading_ord", "score") == sorted(want) and want


def test_page_index_of_documents(spark):
    got = {r.page: r for r in QUERIES["a2_page_index"](spark, D).collect()}
    for r in images(spark, D, "documents").limit(40).collect():
        image = np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w)
        runs, boxes, groups = K.analyse(image)
        x = got[r.page]
        assert (x.w, x.h, x.n_runs, x.n_comps, x.n_clusters) == (r.w, r.h, len(runs), len(boxes), len(groups))


def test_turns_of_each_page(spark):
    """A page is searched in its own turns, and upright."""
    pages = images(spark, D, glyphs=True).limit(6)
    turned = spark.createDataFrame([(r.page, 1, t) for k, r in enumerate(pages.collect()) for t in ((), (2,), (1, 3))[k % 3]], "doc_id long, page_number long, turn int")
    where = pages.selectExpr("page", "page AS doc_id", "1L AS page_number")
    got = rows(S.page_matches(S.with_turns(pages, where, turned), symbol(4), threshold=0.9), "page", "reading_ord", *FIELDS)
    own = {}
    for r in turned.collect():
        own.setdefault(r.doc_id, [0]).append(r.turn)
    want = []
    for r in pages.collect():
        want += rows(S.page_matches(pages.where(f"page = {r.page}"), symbol(4), threshold=0.9, turns=tuple(own.get(r.page, [0]))), "page", "reading_ord", *FIELDS)
    assert got == sorted(want)


def test_lookup_and_search_of_turned_pages(spark, book):
    """Both take the turns of a page's text layer: equal to searches of each page in its own turns, which score higher than upright ones."""
    pages, total = book
    own = lambda p: (0, 2) if p % 3 == 0 else (0, 1) if p % 5 == 0 else (0,)
    img, want = images(spark, D, glyphs=True), {}
    for turns in {own(p) for p in pages}:
        mine = [p for p in pages if own(p) == turns]
        for r in S.page_matches(img.where(img.page.isin(mine)), symbol(4), turns=turns).collect():
            want.setdefault(r.page, []).append((r.reading_ord, *(r[c] for c in FIELDS)))
    index = {p for p, (doc, n) in pages.items() if n == total[doc]}
    flat = lambda ps: sorted((p, *m) for p in ps for m in want.get(p, []))
    assert rows(QUERIES["r4_turned_look_up"](spark, D), "page", "reading_ord", *FIELDS) == flat(index)
    assert rows(QUERIES["r6_turned_search"](spark, D), "page", "reading_ord", *FIELDS) == flat(pages)
    upright = S.page_matches(img, symbol(4)).agg(F.sum("score")).first()[0]
    assert sum(m[-1] for ms in want.values() for m in ms) > upright + 1  # where a turn fits better, its score stands


def test_long_texts_make_long_pages():
    from inkwell.sources.bridge import LARGE_H, large_raster

    assert large_raster("ab " * 100).shape[0] == LARGE_H and large_raster("").sum() == 0
    long = large_raster("a" * 3000)
    assert len(K.components(K.find_runs(long), long.shape[1], 4)[0]) == 3000


def test_a_page_that_fails_leaves_the_others(spark):
    good = images(spark, D, glyphs=True).limit(3)
    bad = spark.createDataFrame([(900, 5, 5, bytearray(b"short")), (901, None, 5, bytearray(b"x")), (902, 4, 4, None)], "page long, w int, h int, bits binary")
    every = S.search_pages(good.unionByName(bad), symbol(1))
    assert {r.page for r in every.where("error is not null").collect()} == {900, 901, 902}
    assert rows(every.where("error is null"), "page", "reading_ord", *FIELDS) == rows(S.page_matches(good, symbol(1)), "page", "reading_ord", *FIELDS)
    report = {r.page: r.error for r in S.scan_report(good.unionByName(bad)).collect()}
    assert all(report[p] for p in (900, 901, 902)) and sum(v is None for v in report.values()) == 3


def test_dedupe_and_reading_order_of_many_boxes():
    rng = np.random.default_rng(5)
    n = 400
    t = [rng.integers(0, 300, n).astype(float), rng.integers(0, 300, n).astype(float), rng.integers(1, 40, n).astype(float), rng.integers(1, 40, n).astype(float)]
    score = rng.integers(0, 20, n) / 20
    for limit in (0.0, 0.2, 0.5):
        kept = []
        for k in sorted(range(n), key=lambda k: (-score[k], k)):
            if all(iou([c[k] for c in t], [c[m] for c in t]) <= limit for m in kept):
                kept.append(k)
        assert K.dedupe(*t, score, np.arange(n), limit) == kept


def test_regions_of_pages(spark):
    page = images(spark, D, glyphs=True).limit(1)
    r = page.first()
    image = np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w)
    asked = spark.createDataFrame([(r.page, 1, 0.25, 0.0, 0.5, 1.0), (r.page, 2, 1.5, 0.0, 0.5, 1.0), (-5, 3, 0.0, 0.0, 1.0, 1.0)], "page long, region long, x double, y double, w double, h double")
    got = {x.region: x for x in raster.cut_regions(page, asked).collect()}
    x0, x1 = int(np.floor(0.25 * r.w)), int(np.ceil(0.75 * r.w))
    assert (np.frombuffer(got[1].bits, np.uint8).reshape(got[1].h, got[1].w)[::2, ::2] == image[:, x0:x1]).all() and got[1].w == 2 * (x1 - x0)
    assert got[2].error == "off the page" and got[2].bits is None and 3 not in got
    big = spark.createDataFrame([(1, 3000, 1000, bytearray(3_000_000))], "page long, w int, h int, bits binary")
    assert raster.cut_regions(big, spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], asked.schema)).first().error == "too large"
