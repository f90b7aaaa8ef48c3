"""Kernels against slow doubles written pixel by pixel, and their properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.config import CONFIG
from inkwell.functions import kernels as K
from inkwell.operators.search import template_from_region
from inkwell.sources.bridge import glyph_raster


def image(seed, h=14, w=18, p=0.4):
    return (np.random.default_rng(seed).random((h, w)) < p).astype(np.uint8)


images = st.builds(image, st.integers(0, 10**6), st.integers(1, 16), st.integers(1, 20), st.sampled_from([0.05, 0.3, 0.6]))


def flood(m):
    """Components by flood fill, in the order of their first pixel."""
    h, w = m.shape
    seen, out = np.zeros_like(m), []
    for y in range(h):
        for x in range(w):
            if m[y, x] and not seen[y, x]:
                stack, cells = [(y, x)], []
                seen[y, x] = 1
                while stack:
                    a, b = stack.pop()
                    cells.append((a, b))
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for d in range(max(0, b - 1), min(w, b + 2)):
                            if m[c, d] and not seen[c, d]:
                                seen[c, d] = 1
                                stack.append((c, d))
                ys, xs = zip(*cells)
                out.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    return out


@settings(max_examples=60, deadline=None)
@given(images)
def test_runs_round_trip_and_components(m):
    r = K.find_runs(m)
    assert np.array_equal(K.image_of(r, m.shape[1], m.shape[0]), m)
    assert [tuple(b) for b in K.components(r, m.shape[1], 1)[0]] == flood(m)


@settings(max_examples=40, deadline=None)
@given(images, st.integers(1, 6))
def test_distance_is_its_closed_form(m, d_max):
    ys, xs = np.nonzero(m)
    far = 3 * d_max + 3
    want = np.full(m.shape, far)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            for a, b in zip(ys, xs):
                u, v = abs(a - y), abs(b - x)
                want[y, x] = min(want[y, x], 3 * max(u, v) + min(u, v))
    assert np.array_equal(K.distance(m, d_max), want)


@settings(max_examples=40, deadline=None)
@given(images, st.integers(0, 3))
def test_clusters_are_the_closure_of_proximity(m, gap):
    boxes = K.components(K.find_runs(m), m.shape[1], 1)[0]
    n = len(boxes)
    near = lambda a, b: a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near(boxes[i], boxes[j]):
                    group[i] = group[j] = min(group[i], group[j])
    want = sorted((min(boxes[i][0] for i in g), min(boxes[i][1] for i in g), max(boxes[i][2] for i in g), max(boxes[i][3] for i in g), sum(boxes[i][4] for i in g), len(g)) for g in ([i for i in range(n) if group[i] == k] for k in set(group)) if len(g) > 1)
    assert sorted(tuple(c) for c in K.clusters(boxes, gap)) == want


def test_two_pixels_that_touch_at_a_corner_are_one_component():
    assert len(K.components(K.find_runs(np.eye(2, dtype=np.uint8)), 2, 1)[0]) == 1


@pytest.mark.parametrize("blank, found", [(1, 1), (2, 0)])
def test_cluster_gap(blank, found):
    m = np.zeros((2, 4 + blank), np.uint8)
    m[:, :2] = m[:, 2 + blank :] = 1
    assert len(K.clusters(K.components(K.find_runs(m), m.shape[1], 1)[0], CONFIG.cluster_gap_px)) == found


def test_specks_stay_in_the_image_only():
    m = np.zeros((5, 9), np.uint8)
    m[0, :3] = 1
    r, boxes, _ = K.analyse(m)
    assert len(r) == 1 and len(boxes) == 0 and K.distance(m, 6)[0, 0] == 0


def test_binarize_edges():
    px = [(255, 255, 255, 255), (0, 0, 0, 255), (0, 0, 0, 15), (159, 159, 159, 255), (160, 160, 160, 255)]
    assert K.binarize(np.array([px], np.uint8)).tolist() == [[0, 1, 0, 1, 0]]


def test_distance_of_one_pixel():
    m = np.zeros((15, 15), np.uint8)
    m[7, 7] = 1
    d = K.distance(m, 6)
    assert (d[8, 9], d[10, 10], d[14, 7]) == (7, 12, 21)


def test_weights_and_combination():
    assert [round(float(v), 4) for v in K.weight_table(10)[:7]] == [1, 0.8333, 0.6667, 0.5, 0.3333, 0.1667, 0]
    assert K.combine(0.8, 1.0) == pytest.approx(0.888889, abs=1e-6)
    assert K.combine(0.0, 0.0) == 0


def test_four_turns_are_the_identity():
    t = K.prepare_template(image(3))
    u = t
    for _ in range(4):
        u = K.rotate(u, 1)
    assert np.array_equal(u.image, t.image) and np.array_equal(u.anchors, t.anchors)
    one = K.rotate(t, 1)
    y, x = np.argwhere(t.image)[0]
    assert one.image[t.image.shape[1] - 1 - x, y] == 1


@settings(max_examples=40, deadline=None)
@given(images, st.integers(1, 24), st.integers(1, 24))
def test_rescale(m, tw, th):
    fh, fw = m.shape
    want = np.zeros((th, tw), np.uint8)
    for y in range(th):
        for x in range(tw):
            if tw < fw or th < fh:
                ya, xa = math.floor(y * fh / th), math.floor(x * fw / tw)
                block = m[ya : min(fh, max(ya + 1, math.ceil((y + 1) * (fh / th)))), xa : min(fw, max(xa + 1, math.ceil((x + 1) * (fw / tw))))]
                want[y, x] = block.mean() >= 0.4
            else:
                want[y, x] = m[min(fh - 1, math.floor(y * fh / th + 0.5)), min(fw - 1, math.floor(x * fw / tw + 0.5))]
    assert np.array_equal(K.rescale(m, tw, th), want)


def slow_matches(t, page, threshold, with_attached):
    """Each placement scored alone, ink pixel by ink pixel."""
    cfg, m = t.cfg, page.image
    H, W = m.shape
    dist = K.distance(m, cfg.dt_max)
    out = []
    for ai, a in enumerate(t.anchors):
        aw, ah = a[2] - a[0] + 1, a[3] - a[1] + 1
        for c in [*page.boxes, *page.groups]:
            w, h = c[2] - c[0] + 1, c[3] - c[1] + 1
            sh, sw = h / ah, w / aw
            if not (0.12 <= sh <= 1.6 and 0.12 <= sw <= 1.6) or abs(sw / sh - 1) > 0.28 or abs(c[4] / (w * h) / (a[4] / (aw * ah)) - 1) > 0.5 or t.image.shape[0] * sh < 6:
                continue
            best = None
            for f in (1.0, 1 - 0.035, 1 + 0.035):
                s = (sh + sw) / 2 * f
                k = t.at(math.floor(100 * s + 0.5))
                th, tw = k.image.shape
                ox0, oy0 = math.floor((c[0] + c[2]) / 2 - k.centres[ai][0] + 0.5), math.floor((c[1] + c[3]) / 2 - k.centres[ai][1] + 0.5)
                for oy in range(oy0 - 1, oy0 + 2):
                    for ox in range(ox0 - 1, ox0 + 2):
                        total = sum(float(k.weights[dist[oy + y, ox + x]]) for y, x in np.argwhere(k.image) if 0 <= oy + y < H and 0 <= ox + x < W)
                        forward = total / max(1, int(k.image.sum()))
                        total, n = 0.0, 0
                        for y in range(max(0, oy), min(H, oy + th)):
                            for x in range(max(0, ox), min(W, ox + tw)):
                                if m[y, x]:
                                    total += float(k.weights[k.dist[y - oy + 6, x - ox + 6]])
                                    n += 1
                        if with_attached:
                            _, comps = K.attached(page, np.array([ox]), np.array([oy]), tw, th, {}, cfg)
                            for b in page.boxes[comps]:
                                for y in range(b[1], b[3] + 1):
                                    for x in range(b[0], b[2] + 1):
                                        if m[y, x] and not (ox <= x < ox + tw and oy <= y < oy + th):
                                            ty, tx = y - oy + 6, x - ox + 6
                                            if 0 <= ty < k.dist.shape[0] and 0 <= tx < k.dist.shape[1]:
                                                total += float(k.weights[k.dist[ty, tx]])
                                            n += 1
                        reverse = total / n if n and forward else 0.0
                        score = 2 * forward * reverse / (forward + reverse) if forward + reverse else 0.0
                        if best is None or score > best[4]:
                            best = (ox, oy, tw, th, score, forward, reverse, s)
            if best and best[4] >= threshold:
                out.append(best)
    return out


@pytest.mark.parametrize("text, kind, with_attached", [("abc hab\n", 1, False), ("abcdefgh" * 3, 3, True), ("i a,b;q i" * 4, 1, True)])
def test_matches_equal_the_slow_double(text, kind, with_attached):
    m = glyph_raster(text)[:56, :220]
    m = np.pad(m, 3)
    m[30:34, 60:64] = 1  # something that can count as a script
    t = template_from_region(glyph_raster(chr(96 + kind)), 0, 0, 20, 28)
    page = K.Page(m, *K.analyse(m)[1:])
    got = K.match_page(t, page, 0.5, with_attached)
    want = np.array(slow_matches(t, page, 0.5, with_attached))
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-9)


def test_pruning_leaves_results_as_they_are():
    m = glyph_raster("abcdefgh hgfedcba" * 5)
    t = template_from_region(glyph_raster("a"), 0, 0, 20, 28)
    every = K.match_page(t, K.Page(m, *K.analyse(m)[1:]), 0.8, keep_all=True)
    some = K.match_page(t, K.Page(m, *K.analyse(m)[1:]), 0.8)
    assert np.allclose(every[every[:, 4] >= 0.8], some)


def test_a_template_finds_its_own_place():
    m = glyph_raster("abcdefgh" * 10)
    t = template_from_region(m, 0, 0, 18, 24)
    best = K.match_page(t, K.Page(m, *K.analyse(m)[1:]), 0.5, attached_ink=False)
    assert best[:, 4].max() == 1.0 and ((best[:, 4] >= 0) & (best[:, 4] <= 1)).all()


def test_anchors_are_cluster_then_pieces():
    pieces = np.array([[0, 0, 4, 4, 20], [6, 0, 9, 4, 10], [0, 8, 3, 9, 5], [20, 0, 29, 9, 40]])
    groups = np.array([[0, 0, 9, 4, 30, 2]])
    assert [int(a[4]) for a in K.choose_anchors(pieces, groups)] == [30, 40, 20]
