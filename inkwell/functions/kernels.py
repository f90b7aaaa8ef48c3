"""Array kernels for one page or template: runs, components, clusters, distance transform, rescaling, scoring.

Images are 2-D uint8 arrays, 1 = ink. Every kernel is vectorised; a page is one
call. ``round half up`` is floor(x + 0.5) throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import CONFIG, Config

BOX = ("x0", "y0", "x1", "y1", "ink")


def half_up(x):
    return np.floor(np.asarray(x, float) + 0.5).astype(np.int64)


def binarize(rgba: np.ndarray, cfg: Config = CONFIG) -> np.ndarray:
    """Ink where a pixel is opaque enough and dark enough."""
    p = rgba.astype(float)
    luma = cfg.luma_r * p[..., 0] + cfg.luma_g * p[..., 1] + cfg.luma_b * p[..., 2]
    return ((p[..., 3] >= cfg.alpha_min) & (luma < cfg.binarize_threshold)).astype(np.uint8)


def find_runs(image: np.ndarray) -> np.ndarray:
    """(y, x0, x1) of the ink runs in row-major order, ends inclusive."""
    h, w = image.shape
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = image
    step = np.diff(edge, axis=1)
    y, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1] - 1
    return np.stack([y, x0, x1], 1).astype(np.int64)


def image_of(runs: np.ndarray, w: int, h: int) -> np.ndarray:
    """The inverse of ``find_runs``."""
    edge = np.zeros((h, w + 1), np.int8)
    np.add.at(edge, (runs[:, 0], runs[:, 1]), 1)
    np.add.at(edge, (runs[:, 0], runs[:, 2] + 1), -1)
    return np.cumsum(edge[:, :w], axis=1, dtype=np.int8).astype(np.uint8)


def expand_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, k) with first[i] <= k < last[i]."""
    size = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(first)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + first[i]


def closure(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by label propagation with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low.copy())  # hooks whole trees, not single nodes
        while True:
            jump = low[low]
            if np.array_equal(jump, low):
                break
            low = jump
        if np.array_equal(low, label):
            break
        label = low
    return label


def touching_runs(runs: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """8-connected pairs of runs in neighbouring rows."""
    step = w + 2
    y, x0, x1 = runs.T
    first = np.searchsorted(y * step + x1, (y - 1) * step + x0 - 1, "left")
    last = np.searchsorted(y * step + x0, (y - 1) * step + x1 + 1, "right")
    return expand_ranges(first, last)


def components(runs: np.ndarray, w: int, min_pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (x0, y0, x1, y1, ink) of the 8-connected components, in the order of their first run, and each run's root."""
    if not len(runs):
        return np.zeros((0, 5), np.int64), np.zeros(0, np.int64)
    root = closure(len(runs), *touching_runs(runs, w))
    boxes = group_boxes(root, runs[:, 1], runs[:, 0], runs[:, 2], runs[:, 0], runs[:, 2] - runs[:, 1] + 1)
    return boxes[boxes[:, 4] >= min_pixels], root


def group_boxes(root, x0, y0, x1, y1, ink) -> np.ndarray:
    """Bounds and ink of each group, in the order of the roots."""
    _, g = np.unique(root, return_inverse=True)
    n = g.max() + 1
    big = np.iinfo(np.int64).max
    out = np.empty((n, 5), np.int64)
    for k, (values, least) in enumerate(((x0, True), (y0, True), (x1, False), (y1, False))):
        col = np.full(n, big if least else -big)
        (np.minimum if least else np.maximum).at(col, g, values)
        out[:, k] = col
    out[:, 4] = np.bincount(g, weights=ink, minlength=n).astype(np.int64)
    return out


#: Pairs of boxes that are held against each other at a time.
PAIRS = 1 << 18


def clusters(boxes: np.ndarray, gap: int) -> np.ndarray:
    """(x0, y0, x1, y1, ink, members) of groups of two or more boxes with edge gaps of at most ``gap``; the boxes do not grow."""
    n = len(boxes)
    if n < 2:
        return np.zeros((0, 6), np.int64)
    s = boxes[np.argsort(boxes[:, 0], kind="stable")]
    root = closure_of_near(s, gap)
    boxes_ = group_boxes(root, *s[:, :5].T)
    size = np.unique(root, return_counts=True)[1]
    out = np.concatenate([boxes_, size[:, None]], 1)
    return out[size >= 2]


def closure_of_near(boxes: np.ndarray, gap: int) -> np.ndarray:
    """Smallest member of each box's cluster.

    The sweep goes along the longer side of the page, as on a narrow page most boxes are within
    reach sideways, and takes some PAIRS at a time; known pairs are cut to a box and its root.
    """
    n = len(boxes)
    v = int(np.ptp(boxes[:, 1]) > np.ptp(boxes[:, 0]))
    order = np.argsort(boxes[:, v], kind="stable")
    t = boxes[order]
    low, high, side_low, side_high = (np.ascontiguousarray(t[:, c]) for c in (v, v + 2, 1 - v, 3 - v))
    first = np.arange(n) + 1
    reach = np.searchsorted(low, high + gap, "right")  # the sweep ends where no box can begin within reach
    total = np.concatenate([[0], np.cumsum(np.maximum(reach - first, 0))])
    a = b = np.zeros(0, np.int64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        i, k = expand_ranges(first[at:end], reach[at:end])
        i += at
        near = (side_low[k] <= side_high[i] + gap) & (side_low[i] <= side_high[k] + gap)
        a, b = np.concatenate([a, order[i[near]]]), np.concatenate([b, order[k[near]]])
        if len(a) > 2 * (n + PAIRS):
            label = closure(n, a, b)
            a = np.flatnonzero(label != np.arange(n))
            b = label[a]
        at = end
    return closure(n, a, b)


#: Rows of an image that are relaxed together, so that they stay in a core's cache.
BAND = 128


def distance(image: np.ndarray, d_max: int) -> np.ndarray:
    """3-4 chamfer distance to the nearest ink in thirds of a pixel, at most 3 * d_max + 3: relaxed d_max + 1 times.

    A pixel depends on the d_max + 1 rows above and below it, so that bands of rows with
    such margins are relaxed one by one, and those without ink not at all.
    """
    far, margin = 3 * d_max + 3, d_max + 1
    h, w = image.shape
    out = np.full((h, w), far, np.uint8 if far < 250 else np.int16)
    inked = np.flatnonzero(image.any(axis=1))
    for y in range(0, h, BAND):
        top, low, end = max(0, y - margin), min(h, y + BAND + margin), min(h, y + BAND)
        k = np.searchsorted(inked, top)
        if k == len(inked) or inked[k] >= low:
            continue
        d = np.full((low - top + 2, w + 2), far, out.dtype)
        d[1:-1, 1:-1][image[top:low] > 0] = 0
        inner, side = d[1:-1, 1:-1], np.empty((low - top, w + 2), out.dtype)
        straight, slanted = np.empty_like(inner), np.empty_like(inner)
        for _ in range(margin):
            np.minimum(d[:-2], d[2:], out=side)
            np.minimum(d[1:-1, :-2], d[1:-1, 2:], out=straight)
            np.minimum(straight, side[:, 1:-1], out=straight)
            straight += 3
            np.minimum(side[:, :-2], side[:, 2:], out=slanted)
            slanted += 4
            np.minimum(straight, slanted, out=straight)
            np.minimum(inner, straight, out=inner)
        out[y:end] = np.minimum(inner[y - top : end - top], far)
    return out.astype(np.uint8)


def rescale(image: np.ndarray, tw: int, th: int, ink_fraction: float = CONFIG.rescale_ink_fraction) -> np.ndarray:
    """Area mean when either axis shrinks, else the nearest pixel."""
    fh, fw = image.shape
    sx, sy = fw / tw, fh / th
    x, y = np.arange(tw), np.arange(th)
    if tw < fw or th < fh:
        xa, ya = np.floor(x * sx).astype(int), np.floor(y * sy).astype(int)
        xb, yb = np.minimum(fw, np.maximum(xa + 1, np.ceil((x + 1) * sx).astype(int))), np.minimum(fh, np.maximum(ya + 1, np.ceil((y + 1) * sy).astype(int)))
        total = np.zeros((fh + 1, fw + 1), np.int64)
        total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
        block = total[yb][:, xb] - total[ya][:, xb] - total[yb][:, xa] + total[ya][:, xa]
        area = (yb - ya)[:, None] * (xb - xa)[None, :]
        return (block / area >= ink_fraction).astype(np.uint8)
    xs, ys = np.minimum(fw - 1, half_up(x * sx)), np.minimum(fh - 1, half_up(y * sy))
    return image[ys][:, xs]


def crop(image: np.ndarray) -> np.ndarray | None:
    """The image cut to its ink, or None without ink."""
    y, x = np.nonzero(image)
    return image[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(y) else None


def weight_table(height: int, cfg: Config = CONFIG) -> np.ndarray:
    """float32 weight of each distance level."""
    ref = max(height, cfg.reference_height_pt * cfg.render_scale)
    cap = max(cfg.tolerance_min_px, cfg.tolerance_ratio * ref)
    d = np.arange(3 * cfg.dt_max + 4) / 3
    shape = {
        "step": lambda: (d <= cap) * 1.0,
        "quadratic": lambda: np.where(d < cap, (1 - d / cap) ** 2, 0.0),
        "smooth": lambda: np.where(d < cap, 1 - (d / cap) ** 2, 0.0),
        "linear": lambda: np.maximum(0.0, 1 - d / cap),
    }[cfg.weight_shape]
    return shape().astype(np.float32)


def combine(forward, reverse, how: str = CONFIG.score_combine):
    f, r = np.asarray(forward, float), np.asarray(reverse, float)
    if how == "min":
        return np.minimum(f, r)
    if how == "geometric":
        return np.sqrt(f * r)
    return np.where(f + r > 0, 2 * f * r / np.where(f + r > 0, f + r, 1), 0.0)


@dataclass
class Scaled:
    """A template at one scale of a hundredth."""

    scale: float
    image: np.ndarray
    y: np.ndarray
    x: np.ndarray
    dist: np.ndarray
    weights: np.ndarray
    centres: np.ndarray


@dataclass
class Template:
    """A query symbol: its image and up to three anchors (x0, y0, x1, y1, ink)."""

    image: np.ndarray
    anchors: np.ndarray
    cfg: Config = CONFIG
    scaled: dict[int, Scaled] = field(default_factory=dict)

    def at(self, key: int) -> Scaled:
        if key not in self.scaled:
            cfg, s = self.cfg, key / 100
            h0, w0 = self.image.shape
            w, h = max(1, int(half_up(w0 * s))), max(1, int(half_up(h0 * s)))
            image = rescale(self.image, w, h, cfg.rescale_ink_fraction)
            y, x = np.nonzero(image)
            a = self.anchors
            left, top = np.floor(a[:, 0] * s), np.floor(a[:, 1] * s)
            right, low = np.ceil((a[:, 2] + 1) * s) - 1, np.ceil((a[:, 3] + 1) * s) - 1
            dist = distance(np.pad(image, cfg.dt_max), cfg.dt_max)
            self.scaled[key] = Scaled(s, image, y, x, dist, weight_table(h, cfg), np.stack([(left + right) / 2, (top + low) / 2], 1))
        return self.scaled[key]


def choose_anchors(pieces: np.ndarray, groups: np.ndarray, cfg: Config = CONFIG) -> np.ndarray:
    """The largest cluster, the largest piece, then further pieces that are large enough."""
    by_ink = pieces[np.argsort(-pieces[:, 4], kind="stable")]
    chosen = [groups[np.argsort(-groups[:, 4], kind="stable")][0][:5]] if len(groups) else []
    for k, piece in enumerate(by_ink):
        if k and (len(chosen) >= cfg.max_anchors or piece[4] < cfg.anchor_min_ink_ratio * by_ink[0][4]):
            break
        chosen.append(piece[:5])
    return np.array(chosen[: max(cfg.max_anchors, 1)])


def prepare_template(image: np.ndarray, cfg: Config = CONFIG) -> Template | None:
    """A template of an image, cut to its ink; None without ink."""
    cut = crop(image)
    if cut is None:
        return None
    pieces, _ = components(find_runs(cut), cut.shape[1], 1)
    return Template(cut, choose_anchors(pieces, clusters(pieces, cfg.cluster_gap_px), cfg), cfg)


def rotate(t: Template, turns: int) -> Template:
    """The template after clockwise-counted quarter turns: a pixel (x, y) of w x h goes to (y, w - 1 - x) once."""
    turns %= 4
    if not turns:
        return t
    h, w = t.image.shape
    a = t.anchors
    one = Template(np.rot90(t.image).copy(), np.stack([a[:, 1], w - 1 - a[:, 2], a[:, 3], w - 1 - a[:, 0], a[:, 4]], 1), t.cfg)
    return rotate(one, turns - 1)


@dataclass
class Page:
    """A page ready for matching; ``boxes`` and ``groups`` as from components() and clusters()."""

    image: np.ndarray
    boxes: np.ndarray
    groups: np.ndarray
    dist: np.ndarray | None = None
    by_left: np.ndarray | None = None


def analyse(image: np.ndarray, cfg: Config = CONFIG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, components, clusters) of a page."""
    runs = find_runs(image)
    boxes, _ = components(runs, image.shape[1], cfg.min_cc_pixels)
    return runs, boxes, clusters(boxes, cfg.cluster_gap_px)


def is_comma(image: np.ndarray, box: np.ndarray, cfg: Config = CONFIG) -> bool:
    """Narrow, with a solid wide head and a thin tail."""
    x0, y0, x1, y1 = box[:4]
    w, h = x1 - x0 + 1, y1 - y0 + 1
    if w > cfg.punct_max_aspect * h:
        return False
    part = image[y0 : y1 + 1, x0 : x1 + 1]
    ink = part.sum(1)
    span = np.where(ink > 0, w - part[:, ::-1].argmax(1) - part.argmax(1), 0)
    head = np.arange(h) < max(1, int(half_up(cfg.punct_head_fraction * h)))
    tail = np.arange(h) >= int(np.ceil(h / 2))
    most = lambda m: int(span[m].max(initial=0))
    return bool(
        most(head) >= most(~head)
        and most(head) >= cfg.punct_head_min_width * w
        and ink[head].sum() >= cfg.punct_head_solidity * span[head].sum()
        and most(tail) <= cfg.punct_tail_max_width * w
    )


def attached(page: Page, ox: np.ndarray, oy: np.ndarray, w: int, h: int, comma: dict[int, bool], cfg: Config = CONFIG) -> tuple[np.ndarray, np.ndarray]:
    """(placement, component) pairs of scripts and accents next to windows. Only components are tested whose left edge can be near enough."""
    if page.by_left is None:
        page.by_left = np.argsort(page.boxes[:, 0], kind="stable")
    left = page.boxes[page.by_left, 0]
    low = np.searchsorted(left, ox - max(cfg.accent_max_width * w, 0))
    high = np.searchsorted(left, ox + w + max(cfg.script_max_gap * h, 0), "right")
    p, k = expand_ranges(low, high)
    comp = page.by_left[k]
    x0, y0, x1, y1 = (page.boxes[comp, i] for i in range(4))
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    ox, oy = ox[p], oy[p]
    right, bottom = ox + w, oy + h - 1
    script = (x0 >= right - 1) & (x0 <= right + cfg.script_max_gap * h) & (bh >= cfg.script_min_height * h) & (bh <= cfg.script_max_height * h)
    lap, off = cfg.script_min_overlap * h, cfg.script_min_offset * h
    sub = script & (y0 <= bottom - lap) & (y1 >= bottom + off)
    sup = script & (y1 >= oy + lap) & (y0 <= oy - off)
    common = np.minimum(x1, right - 1) - np.maximum(x0, ox) + 1
    over = (x0 < right) & (x1 >= ox) & (x0 >= ox - cfg.accent_max_width * w) & (bh <= cfg.accent_max_height * h) & (bw <= cfg.accent_max_width * w) & (common >= cfg.accent_min_overlap * bw)
    over &= ~((bh <= cfg.rule_max_thickness_px) & (bw >= cfg.rule_min_width * w))
    gap = cfg.accent_max_gap * h
    over &= ((y1 < oy) & (oy - y1 - 1 <= gap)) | ((y0 > bottom) & (y0 - bottom - 1 <= gap))
    only_sub = sub & ~sup
    for c in np.unique(comp[only_sub]):
        if c not in comma:
            comma[c] = is_comma(page.image, page.boxes[c], cfg)
        if comma[c]:
            only_sub &= comp != c
    keep = np.flatnonzero(only_sub | sup | over)
    keep = keep[np.lexsort((comp[keep], p[keep]))]
    return p[keep], comp[keep]


def dedupe(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, score: np.ndarray, order: np.ndarray, iou: float) -> list[int]:
    """Places of the boxes that stay, best score first: one goes if it overlaps one that stays by more than ``iou``. Only boxes in cells next to each other can overlap."""
    kept: list[int] = []
    cells: dict[tuple[int, int], list[int]] = {}
    cw, ch = max(float(w.max(initial=1)), 1.0), max(float(h.max(initial=1)), 1.0)
    box = list(zip(x.tolist(), y.tolist(), w.tolist(), h.tolist()))
    for k in np.lexsort((order, -score)).tolist():
        ax, ay, aw, ah = box[k]
        i, j = int(ax // cw), int(ay // ch)
        near = (m for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for m in cells.get((a, b), ()))
        for m in near:
            bx, by, bw, bh = box[m]
            both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
            if both and both / (aw * ah + bw * bh - both) > iou:
                break
        else:
            kept.append(k)
            cells.setdefault((i, j), []).append(k)
    return kept


def reading_order(x: np.ndarray, y: np.ndarray, h: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the boxes in reading order, the line of each): from top to bottom a box joins the last line if its centre is near the line's first one."""
    centre = y + h / 2.0
    by_centre = np.lexsort((order, centre))
    line = np.zeros(len(x), np.int64)
    n, first, tall = 0, 0.0, 0.0
    for k, c, t in zip(by_centre.tolist(), centre[by_centre].tolist(), h[by_centre].tolist()):
        if n and abs(c - first) <= 0.5 * min(t, tall):
            tall = max(tall, t)
        else:
            n, first, tall = n + 1, c, t
        line[k] = n
    place = np.empty(len(x), np.int64)
    place[by_centre] = np.arange(len(x))
    return np.lexsort((place, x, line)), line


class Field:
    """A page's distances and ink with room for a window of ``my`` x ``mx`` on every side, so that no place needs a test of its own."""

    def __init__(self, image: np.ndarray, dist: np.ndarray, my: int, mx: int, cfg: Config = CONFIG):
        self.h, self.w, self.my, self.mx = *image.shape, my, mx
        none = 3 * cfg.dt_max + 4  # a level of weight 0, for places off the page
        self.dist = np.full((self.h + 2 * my, self.w + 2 * mx), none, np.uint8)
        self.dist[my : my + self.h, mx : mx + self.w] = dist
        self.ink = np.pad(image, ((my, my), (mx, mx)))
        self.stride = self.dist.shape[1]

    def base(self, x: np.ndarray, y: np.ndarray, w: int, h: int) -> np.ndarray:
        """Where windows of w x h begin."""
        return (np.clip(y, -h, self.h) + self.my) * self.stride + np.clip(x, -w, self.w) + self.mx


def level_weights(st: Scaled) -> np.ndarray:
    return np.append(st.weights, np.float32(0)).astype(float)


def forward_at(st: Scaled, field: Field, base: np.ndarray) -> np.ndarray:
    """Mean weight of the page's distance under the template's ink, at each placement."""
    table, out = level_weights(st), np.zeros(len(base))
    if len(st.x):
        ink, flat = st.y * field.stride + st.x, field.dist.ravel()
        for i in range(0, len(base), 4096):
            out[i : i + 4096] = table[flat[base[i : i + 4096, None] + ink]].sum(1) / len(st.x)
    return out


def window_at(st: Scaled, field: Field, base: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the weights of the template's distance under the page's ink in the window, pixels of that ink), at each placement."""
    h, w = st.image.shape
    inner = level_weights(st)[st.dist[pad : pad + h, pad : pad + w]].ravel()
    windows = np.lib.stride_tricks.sliding_window_view(field.ink, (h, w))
    total, count = np.zeros(len(base)), np.zeros(len(base))
    for i in range(0, len(base), 1024):
        sy, sx = np.divmod(base[i : i + 1024], field.stride)
        win = windows[sy, sx].reshape(len(sy), h * w)
        total[i : i + 1024] = win @ inner
        count[i : i + 1024] = win.sum(1)
    return total, count


def match_page(t: Template, page: Page, threshold: float, attached_ink: bool = True, keep_all: bool = False, stats: dict | None = None) -> np.ndarray:
    """Best placement of each gated (anchor, candidate) in order: x, y, w, h, score, forward, reverse, scale.

    A placement whose score could not reach the threshold even with a perfect
    reverse term is not scored further, which leaves the results as they are.
    """
    cfg, image = t.cfg, page.image
    H, W = image.shape
    if page.dist is None:
        page.dist = distance(image, cfg.dt_max)
    cand = np.concatenate([page.boxes[:, :5], page.groups[:, :5]]).astype(np.int64)
    cw, ch = cand[:, 2] - cand[:, 0] + 1, cand[:, 3] - cand[:, 1] + 1
    rows = []
    for ai, a in enumerate(t.anchors):
        aw, ah = a[2] - a[0] + 1, a[3] - a[1] + 1
        sh, sw = ch / ah, cw / aw
        ok = (sh >= cfg.scale_min) & (sh <= cfg.scale_max) & (sw >= cfg.scale_min) & (sw <= cfg.scale_max) & (np.abs(sw / sh - 1) <= cfg.scale_asymmetry_max)
        ok &= np.abs(cand[:, 4] / (cw * ch) / (a[4] / (aw * ah)) - 1) <= cfg.density_tolerance
        ok &= t.image.shape[0] * sh >= cfg.min_scaled_height_px
        for si, f in enumerate((1.0, 1 - cfg.scale_refine, 1 + cfg.scale_refine)):
            c = np.flatnonzero(ok)
            rows.append(np.stack([np.full(len(c), ai), c, np.full(len(c), si), (sh[c] + sw[c]) / 2 * f], 1))
    if stats is not None:
        stats["candidates"] = len(cand) * len(t.anchors)
        stats["gated"] = sum(len(r) for r in rows) // 3
    rows = np.concatenate(rows) if rows else np.zeros((0, 4))
    if not len(rows):
        return np.zeros((0, 8))
    keys = half_up(100 * rows[:, 3])
    found, pruned, comma = [], 0, {}
    J = np.arange(-cfg.jitter_px, cfg.jitter_px + 1)
    jy, jx = (g.ravel() for g in np.meshgrid(J, J, indexing="ij"))
    sizes = [t.at(int(key)).image.shape for key in np.unique(keys)]
    area = Field(image, page.dist, max(s[0] for s in sizes), max(s[1] for s in sizes), cfg)
    for key in np.unique(keys):
        st, mine = t.at(int(key)), rows[keys == key]
        h, w = st.image.shape
        ai, c = mine[:, 0].astype(int), mine[:, 1].astype(int)
        ox = half_up((cand[c, 0] + cand[c, 2]) / 2 - st.centres[ai, 0])
        oy = half_up((cand[c, 1] + cand[c, 3]) / 2 - st.centres[ai, 1])
        n = len(jx)
        X, Y = (ox[:, None] + jx).ravel(), (oy[:, None] + jy).ravel()
        base = area.base(X, Y, w, h)
        forward = forward_at(st, area, base)
        live = np.flatnonzero(forward > 0)
        if not keep_all:
            live = live[combine(forward[live], 1.0, cfg.score_combine) >= threshold - 1e-9]
        pruned += len(X) - len(live)
        reverse = np.full(len(X), np.nan)
        reverse[forward == 0] = 0
        if len(live):
            pad, table = cfg.dt_max, level_weights(st)
            rsum, rcount = window_at(st, area, base[live], pad)
            if attached_ink:
                for i in range(0, len(live), 512):
                    k = live[i : i + 512]
                    p, comp = attached(page, X[k], Y[k], w, h, comma, cfg)
                    for q, cc in zip(p, comp):
                        x0, y0, x1, y1 = page.boxes[cc, :4]
                        part = image[y0 : y1 + 1, x0 : x1 + 1]
                        py, px = np.nonzero(part)
                        py, px = py + y0 - Y[k[q]], px + x0 - X[k[q]]
                        out = ~((px >= 0) & (px < w) & (py >= 0) & (py < h))
                        ty, tx = py[out] + pad, px[out] + pad
                        inside = (ty >= 0) & (ty < st.dist.shape[0]) & (tx >= 0) & (tx < st.dist.shape[1])
                        rsum[i + q] += table[st.dist[ty[inside], tx[inside]]].sum()
                        rcount[i + q] += out.sum()
            reverse[live] = np.where(rcount > 0, rsum / np.maximum(rcount, 1), 0)
        score = combine(forward, np.nan_to_num(reverse), cfg.score_combine)
        k = np.flatnonzero(~np.isnan(reverse))
        found.append(np.stack([ai[k // n], c[k // n], mine[k // n, 2], k % n, X[k], Y[k], np.full(len(k), w), np.full(len(k), h), score[k], forward[k], np.nan_to_num(reverse[k]), mine[k // n, 3]], 1))
    if stats is not None:
        stats["scored"], stats["pruned"] = len(rows) * len(jx), pruned
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 8], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, 0] != every[:-1, 0]) | (every[1:, 1] != every[:-1, 1])
    best = every[first]
    if not keep_all:
        best = best[best[:, 8] >= threshold]
    return best[:, 4:]
