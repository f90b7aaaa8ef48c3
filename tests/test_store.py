"""The stored index: codec, searches and gates over it, many templates, regions from runs."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.config import CONFIG, Config
from inkwell.functions import codec
from inkwell.functions import kernels as K
from inkwell.operators import raster, store
from inkwell.operators import search as S
from inkwell.plans import QUERIES
from inkwell.plans.raster_queries import images, symbol
from inkwell.plans.store_queries import MARK
from inkwell.sources.bridge import LARGE_H, LARGE_W, large_raster

D = str(compare.DATA)
FIELDS = ("page", "reading_ord", "x_norm", "y_norm", "w_norm", "h_norm", "score")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def image_of(r):
    return np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w)


@pytest.fixture(scope="module")
def glyphs(spark, tmp_path_factory):
    """Glyph pages, one without ink, and three that fail; and their stored index."""
    blank = spark.createDataFrame([(800, 40, 30, bytearray(1200))], "page long, w int, h int, bits binary")
    bad = spark.createDataFrame([(900, 5, 5, bytearray(b"short")), (901, None, 5, bytearray(b"x")), (902, 4, 4, None)], blank.schema)
    pages = images(spark, D, glyphs=True).unionByName(blank).unionByName(bad)
    path = str(tmp_path_factory.mktemp("store") / "pages")
    store.stored_index(pages).write.parquet(path)
    return pages, spark.read.parquet(path)


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for v in ([], [0], [127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**35 - 1], rng.integers(0, 300, 1000), rng.integers(0, 2**35, 1000)):
        v = np.array(v, np.int64)
        assert codec.unpack(codec.pack(v)).tolist() == v.tolist()
    x = rng.integers(-1000, 1000, 500)
    assert codec.unfold(codec.fold(x)).tolist() == x.tolist()
    for bad in ([-1], [2**35]):
        with pytest.raises(ValueError):
            codec.pack(np.array(bad))
    for bad in (b"\x80", b"\xff" * 6 + b"\x00"):
        with pytest.raises(ValueError):
            codec.unpack(bad)


@pytest.mark.parametrize("share", [0, 0.01, 0.3, 0.9, 1])
@pytest.mark.parametrize("shape", [(1, 1), (1, 300), (300, 1), (40, 70), (3, 70_000)])
def test_pages_round_trip(share, shape):
    image = (np.random.default_rng(3).random(shape) < share).astype(np.uint8)
    runs, boxes, groups = K.analyse(image)
    data = codec.pack_runs(runs, shape[0])
    assert codec.unpack_runs(data, shape[0]).tolist() == runs.tolist()
    assert codec.unpack_boxes(codec.pack_boxes(boxes), 5).tolist() == boxes.tolist() and codec.unpack_boxes(codec.pack_boxes(groups), 6).tolist() == groups.tolist()


def test_bytes_of_a_large_page(spark):
    """A page of 1836 x 2376 pixels and 1,400 components takes less than 0.4 MB, by the bytes that are stored."""
    image = large_raster("the quick brown fox jumps over the lazy dog")
    page = spark.createDataFrame([(1, LARGE_W, LARGE_H, bytearray(image.tobytes()))], "page long, w int, h int, bits binary")
    stored = store.stored_index(page)
    size = store.stored_bytes(stored).first().bytes
    r = stored.first()
    assert 50_000 < size < 400_000 and size > len(r.runs) and len(r.comps) == 1400
    assert (image_of(store.expand_store(stored).first()) == image).all()


def test_search_of_stored_pages_equals_that_of_images(spark, glyphs):
    pages, stored = glyphs
    for t, options in ((symbol(1), {}), (symbol(4), {"turns": (0, 1, 3), "threshold": 0.8}), (symbol(2), {"attached_ink": False}), (symbol(5), {"keep_all": True})):
        want = S.search_pages(pages, t, **options)
        got = store.search_store(stored, t, **options)
        assert rows(got.where("error is null"), *FIELDS) == rows(want.where("error is null"), *FIELDS) and got.where("error is null").count()
        assert rows(got.where("error is not null"), "page") == rows(want.where("error is not null"), "page") == [(900,), (901,), (902,)]
    assert rows(QUERIES["r2_stored_matches"](spark, D), *FIELDS) == rows(QUERIES["r2_page_matches"](spark, D), *FIELDS)


def test_own_turns_of_stored_pages(spark, glyphs):
    pages = glyphs[0].where("page < 800").withColumn("turns", F.when(F.col("page") % 3 > 0, F.array(F.lit(0), (F.col("page") % 3).cast("int"))))
    got = store.stored_matches(store.stored_index(pages), symbol(4), threshold=0.8)
    assert rows(got, *FIELDS) == rows(S.page_matches(pages, symbol(4), threshold=0.8), *FIELDS)


def test_pages_without_gated_candidates_are_not_expanded(spark, glyphs):
    """The gate keeps exactly the pages with a pair, before any Python runs."""
    pages, stored = glyphs
    counts = {r.page: (r.candidates, r.gated) for r in store.gate_counts(stored, symbol(1)).collect()}
    statistics = {r.page: r for r in S.match_statistics(pages, symbol(1)).where("error is null").collect()}
    assert {p: (s.candidates, s.gated) for p, s in statistics.items() if s.candidates} == {p: c for p, c in counts.items() if c[0]}
    tall = K.prepare_template(np.ones((200, 3), np.uint8))
    few = store.gated_pages(stored, tall)
    assert few.count() == sum(r.gated > 0 for r in store.gate_counts(stored, tall).collect()) == 0
    assert store.gated_pages(stored, symbol(1)).count() == sum(g > 0 for _, g in counts.values()) < stored.count()
    plan = store.stored_matches(stored, symbol(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("exists(") and "Exchange" not in plan  # the filter is below the kernel


def test_gate_keeps_and_drops_pages(spark):
    gated = [r.gated for r in QUERIES["r2_gate_counts"](spark, D).collect()]
    assert min(gated) == 0 < max(gated)


def slow_gate(template, cand, cfg=CONFIG):
    """(anchor, candidate) pairs by the gate's definition, one after another."""
    out = set()
    for ai, a in enumerate(template.anchors.tolist()):
        aw, ah = a[2] - a[0] + 1, a[3] - a[1] + 1
        for ci, c in enumerate(cand):
            cw, ch = c[2] - c[0] + 1, c[3] - c[1] + 1
            sh, sw = ch / ah, cw / aw
            if cfg.scale_min <= sh <= cfg.scale_max and cfg.scale_min <= sw <= cfg.scale_max and abs(sw / sh - 1) <= cfg.scale_asymmetry_max:
                if abs(c[4] / (cw * ch) / (a[4] / (aw * ah)) - 1) <= cfg.density_tolerance and template.image.shape[0] * sh >= cfg.min_scaled_height_px:
                    out.add((ai, ci))
    return out


def test_many_templates_equal_single_gates(spark):
    """The join over cells finds what each template's own gate finds, without a nested loop, on pages of text and of glyphs."""
    pages = images(spark, D).unionByName(images(spark, D, glyphs=True).withColumn("page", F.col("page") + 1000))
    stored, templates = store.stored_index(pages), store.template_table(pages)
    pairs = store.gated_candidates(store.candidate_rows(stored), templates)
    got = {tuple(r) for r in pairs.collect()}
    each = pages.collect()
    cands = {r.page: np.concatenate([x[:, :5] for x in K.analyse(image_of(r))[1:]]).tolist() for r in each}
    want, n = set(), 0
    for r in each:
        t = K.prepare_template(image_of(r))
        if t is not None:
            n += 1
            for page, cand in cands.items():
                want |= {(r.page, a, page, c) for a, c in slow_gate(t, cand)}
    assert n >= 50 and got == want and want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_reach_the_gate_s_edges(spark):
    """Ratios at the bounds of the gate, and of cells, are found."""
    sizes = [(k, w, h) for k, (w, h) in enumerate((w, h) for w in (1, 2, 3, 5, 8, 13, 50, 100, 128, 160, 200) for h in (1, 2, 3, 6, 12, 50, 72, 100, 128, 160))]
    cand = spark.createDataFrame([(1, k, w, h, max(1, w * h * 3 // 4)) for k, w, h in sizes], "page long, cand int, w int, h int, ink int")
    anchors = [(k, h, [(0, 0, w - 1, h - 1, max(1, w * h // 2))]) for k, w, h in sizes]
    templates = spark.createDataFrame(anchors, "template_id long, h int, anchors array<struct<x0:int,y0:int,x1:int,y1:int,ink:int>>")
    got = {(r.template_id, r.cand) for r in store.gated_candidates(cand, templates).collect()}
    want = set()
    boxes = [(0, 0, w - 1, h - 1, max(1, w * h * 3 // 4)) for _, w, h in sizes]
    for k, h, a in anchors:
        t = K.Template(np.zeros((h, 1), np.uint8), np.array(a))
        want |= {(k, c) for _, c in slow_gate(t, boxes)}
    assert got == want and len(want) > 100


def test_regions_from_runs_equal_those_from_pixels(spark, glyphs):
    pages = glyphs[0].where("page <= 800")
    rng = np.random.default_rng(5)
    asked = spark.createDataFrame([(int(p), k, *map(float, rng.uniform(-0.3, 0.9, 2)), *map(float, rng.uniform(0, 0.8, 2))) for p in (0, 1, 2, 800) for k in range(8)] + [(0, 99, 0.0, 0.0, 1.0, 1.0), (3, 1, 1.2, 0.0, 0.3, 0.3), (4, 1, 0.1, 0.1, 0.0, 0.5)], "page long, region long, x double, y double, w double, h double")
    small = Config(max_snip_pixels=40_000.0)
    cut = store.cut_runs(raster.page_index(pages), asked, cfg=small).collect()
    want = {(r.page, r.region): r for r in raster.cut_regions(pages, asked).collect()}
    assert len(cut) == len(want) == 35
    seen = set()
    for r in cut:
        w = want[r.page, r.region]
        assert (r.w, r.h) == (w.w, w.h)
        error = w.error or ("too large" if r.w * r.h > 40_000 else None)
        assert r.error == error and (r.runs is None) == (error is not None)
        seen.add(error)
        if error is None:
            m = K.image_of(np.array([(x.y, x.x0, x.x1) for x in r.runs], np.int64).reshape(-1, 3), r.w // 2, r.h // 2)
            assert (m == image_of(w)[::2, ::2]).all()
    assert seen == {None, "off the page", "too large"}


def test_statistics_of_the_search(spark):
    """The kernel's own counts: pairs, gated pairs, placements, and those that the bound spares."""
    pages = images(spark, D, glyphs=True).limit(8)
    t = symbol(1)
    got = {r.page: (r.candidates, r.gated, r.scored, r.pruned) for r in S.match_statistics(pages, t, 0.9).collect()}
    for r in pages.collect():
        image = image_of(r)
        _, boxes, groups = K.analyse(image)
        cand = np.concatenate([boxes[:, :5], groups[:, :5]])
        gated = slow_gate(t, cand.tolist())
        dist, pruned = K.distance(image, CONFIG.dt_max), 0
        H, W = image.shape
        for ai, ci in gated:
            a, c = t.anchors[ai], cand[ci]
            s0 = ((c[2] - c[0] + 1) / (a[2] - a[0] + 1) + (c[3] - c[1] + 1) / (a[3] - a[1] + 1)) / 2
            for f in (1.0, 1 - CONFIG.scale_refine, 1 + CONFIG.scale_refine):
                st = t.at(int(K.half_up(100 * (s0 * f))))
                ox, oy = K.half_up((c[0] + c[2]) / 2 - st.centres[ai, 0]), K.half_up((c[1] + c[3]) / 2 - st.centres[ai, 1])
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        total = 0.0
                        for y, x in zip(st.y + oy + dy, st.x + ox + dx):
                            total += float(st.weights[dist[y, x]]) if 0 <= y < H and 0 <= x < W else 0.0
                        forward = total / len(st.x)
                        pruned += not (forward > 0 and 2 * forward / (forward + 1) >= 0.9 - 1e-9)
        assert got[r.page] == (len(cand) * len(t.anchors), len(gated), len(gated) * 27, pruned)


def test_mark_has_anchors():
    assert len(MARK.anchors) >= 2
