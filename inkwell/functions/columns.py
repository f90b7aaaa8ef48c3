"""Column functions of the engine's geometry, scores and text rules. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG, INDEX_TITLE, NOTATION_TITLE, Config


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


# pixels and boxes


def ink_of(r: Column, g: Column, b: Column, a: Column, cfg: Config = CONFIG) -> Column:
    """1 where a pixel is ink."""
    luma = F.lit(cfg.luma_r) * r + F.lit(cfg.luma_g) * g + F.lit(cfg.luma_b) * b
    return F.when((a >= cfg.alpha_min) & (luma < cfg.binarize_threshold), 1).otherwise(0)


def box_size(x0: Column, x1: Column) -> Column:
    return x1 - x0 + 1


def box_centre(x0: Column, x1: Column) -> Column:
    return (x0 + x1) / F.lit(2.0)


def density(ink: Column, w: Column, h: Column) -> Column:
    return ink / (w * h)


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of boxes with exclusive right and lower edges."""
    ix = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return F.when(ix * iy == 0, F.lit(0.0)).otherwise(ix * iy / (aw * ah + bw * bh - ix * iy))


def rotate_box(x, y, w, h, rotation: Column) -> list[Column]:
    """A normalised box as displayed after a clockwise rotation of 0, 90, 180 or 270 degrees."""
    pick = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
    return [pick(x, 1 - y - h, 1 - x - w, y), pick(y, x, 1 - y - h, 1 - x - w), pick(w, h, w, h), pick(h, w, h, w)]


def normalised(x, y, w, h, page_w, page_h) -> list:
    """A box as shares of its page; of columns, arrays or numbers."""
    return [x / page_w, y / page_h, w / page_w, h / page_h]


def stepped(current, direction, n):
    """The place of the match before or after the current one among n, around the ends; of columns or numbers."""
    return (current + direction + n) % n


# template scales and scores


def scale_key(s: Column) -> Column:
    return half_up(s * 100).cast("int")


def refined_scales(s0: Column, cfg: Config = CONFIG) -> Column:
    return F.array(s0, s0 * (1 - cfg.scale_refine), s0 * (1 + cfg.scale_refine))


def scaled_anchor(lo: Column, hi: Column, s: Column) -> tuple[Column, Column, Column]:
    """(low edge, high edge, centre) of an anchor on one axis at scale s."""
    a, b = F.floor(lo * s), F.ceil((hi + 1) * s) - 1
    return a, b, (a + b) / F.lit(2.0)


def weight(level: Column, height: Column, shape: str = CONFIG.weight_shape, cfg: Config = CONFIG) -> Column:
    """float weight of a distance level in thirds of a pixel, for a template of that height."""
    cap = F.greatest(F.lit(cfg.tolerance_min_px), F.greatest(height, F.lit(cfg.reference_height_pt * cfg.render_scale)) * cfg.tolerance_ratio)
    d = level / F.lit(3.0)
    part = {
        "linear": F.greatest(F.lit(0.0), 1 - d / cap),
        "step": F.when(d <= cap, 1.0).otherwise(0.0),
        "quadratic": F.when(d < cap, (1 - d / cap) * (1 - d / cap)).otherwise(0.0),
        "smooth": F.when(d < cap, 1 - (d / cap) * (d / cap)).otherwise(0.0),
    }[shape]
    return part.cast("float")


def combine(f: Column, r: Column, how: str = CONFIG.score_combine) -> Column:
    if how == "min":
        return F.least(f, r)
    if how == "geometric":
        return F.sqrt(f * r)
    return F.when(f + r > 0, 2 * f * r / (f + r)).otherwise(0.0)


def gate(cw, ch, cink, aw, ah, adensity, template_h, cfg: Config = CONFIG) -> Column:
    """The loose geometric test of a candidate against an anchor."""
    sh, sw = ch / ah, cw / aw
    return (
        sh.between(cfg.scale_min, cfg.scale_max)
        & sw.between(cfg.scale_min, cfg.scale_max)
        & (F.abs(sw / sh - 1) <= cfg.scale_asymmetry_max)
        & (F.abs(cink / (cw * ch) / adensity - 1) <= cfg.density_tolerance)
        & (template_h * sh >= cfg.min_scaled_height_px)
    )


def script_kind(x0, y0, x1, y1, ox, oy, w, h, cfg: Config = CONFIG) -> Column:
    """'sub', 'super', 'both' or null for a component next to a window."""
    right, bottom, ch = ox + w, oy + h - 1, y1 - y0 + 1
    near = (x0 >= right - 1) & (x0 <= right + cfg.script_max_gap * h) & (ch >= cfg.script_min_height * h) & (ch <= cfg.script_max_height * h)
    sub = (y0 <= bottom - cfg.script_min_overlap * h) & (y1 >= bottom + cfg.script_min_offset * h)
    sup = (y1 >= oy + cfg.script_min_overlap * h) & (y0 <= oy - cfg.script_min_offset * h)
    return F.when(near & sub & sup, "both").when(near & sub, "sub").when(near & sup, "super")


def is_accent(x0, y0, x1, y1, ox, oy, w, h, cfg: Config = CONFIG) -> Column:
    right, bottom, cw, ch = ox + w, oy + h - 1, x1 - x0 + 1, y1 - y0 + 1
    common = F.least(x1, right - 1) - F.greatest(x0, ox) + 1
    rule = (ch <= cfg.rule_max_thickness_px) & (cw >= cfg.rule_min_width * w)
    gap = cfg.accent_max_gap * h
    above, below = (y1 < oy) & (oy - y1 - 1 <= gap), (y0 > bottom) & (y0 - bottom - 1 <= gap)
    fits = (x0 < right) & (x1 >= ox) & (x0 >= ox - cfg.accent_max_width * w) & (ch <= cfg.accent_max_height * h) & (cw <= cfg.accent_max_width * w)
    return fits & (common >= cfg.accent_min_overlap * cw) & ~rule & (above | below)


# text layer


def quarter_turns(a: Column, b: Column) -> Column:
    """Counter-clockwise quarter turns of a baseline (a, b) on an upright page, y up in the file."""
    return F.pmod(half_up(F.atan2(b, a) / F.lit(math.pi / 2)), F.lit(4)).cast("int")


def text_box(t: Column, width: Column, height: Column, page_w: float, page_h: float) -> list[Column]:
    """Normalised x, y, w, h of an item with matrix t (six values) along its own baseline, y down."""
    a, b, c, d, e, f = (F.get(t, i) for i in range(6))
    falsy = lambda x, other: F.when(x.isNull() | (x == 0), other).otherwise(x)
    up, along = F.hypot(c, d), F.hypot(a, b)
    size = falsy(up, F.coalesce(height, F.lit(0.0)))
    n, m = falsy(along, F.lit(1.0)), falsy(up, F.lit(1.0))
    len_ = F.coalesce(width, F.lit(0.0))
    xs = [e + a / n * s + c / m * q * size for s, q in ((F.lit(0.0), 0.8), (F.lit(0.0), -0.2), (len_, 0.8), (len_, -0.2))]
    ys = [page_h - (f + b / n * s + d / m * q * size) for s, q in ((F.lit(0.0), 0.8), (F.lit(0.0), -0.2), (len_, 0.8), (len_, -0.2))]
    x0, y0 = F.least(*xs), F.least(*ys)
    return [x0 / page_w, y0 / page_h, (F.greatest(*xs) - x0) / page_w, (F.greatest(*ys) - y0) / page_h]


def is_index_title(title: Column) -> Column:
    return title.rlike(INDEX_TITLE)


def is_notation_head(top: Column, cfg: Config = CONFIG) -> Column:
    """The topmost line, without a page number before or after it, names a notation list."""
    bare = F.regexp_replace(F.regexp_replace(top, r"(?i)^(?:\d+|[ivxlc]+)\s+", ""), r"(?i)\s+(?:\d+|[ivxlc]+)$", "")
    return (F.length(bare) <= cfg.index_heading_max_chars) & bare.rlike(NOTATION_TITLE)


def notation_rank(title: Column) -> Column:
    return F.when(title.rlike(r"(?i)notation|symbol"), 0).otherwise(1)


def upper_median(values: Column) -> Column:
    """The upper median of an array; 0 if it is empty."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) / 2).cast("int"))).otherwise(0.0)


# order and cache


def page_rank(page: Column, anchor: Column, reserved: Column) -> Column:
    """-1 for reserved pages, 0 for the anchor, odd before it, even after."""
    return F.when(reserved, -1).when(page == anchor, 0).when(page < anchor, 2 * (anchor - page) - 1).otherwise(2 * (page - anchor))


def scan_key(page: Column, start: Column, first_pos: Column) -> Column:
    """Sort key of the scan order: referenced pages in their order, then start .. 1, then start + 1 .. n."""
    return F.when(first_pos.isNotNull(), F.struct(F.lit(0).alias("g"), first_pos.cast("long").alias("k"))).when(page <= start, F.struct(F.lit(1).alias("g"), (start - page).cast("long").alias("k"))).otherwise(
        F.struct(F.lit(2).alias("g"), page.cast("long").alias("k"))
    )


def compact_bytes(h, runs, comps, clusters, width) -> Column:
    """Exact bytes of a compact page."""
    return 4 * (h + 1) + 4 * runs * F.when(width < 65536, 1).otherwise(2) + 20 * comps + 24 * clusters + 4 * comps


def index_scale(w: Column, h: Column, cfg: Config = CONFIG) -> Column:
    """The render scale of a page: the default, or the first that keeps it within the pixel limit, shrunk by a hundredth at a time."""
    px = F.ceil(w * cfg.render_scale) * F.ceil(h * cfg.render_scale)
    start = F.lit(cfg.render_scale) * F.sqrt(F.lit(cfg.max_index_pixels) / px)
    fits = lambda s: F.ceil(w * s) * F.ceil(h * s) <= cfg.max_index_pixels
    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, lambda s, _: F.when(fits(s), s).otherwise(s * 0.99))
    return F.when(px <= cfg.max_index_pixels, F.lit(cfg.render_scale)).otherwise(shrunk)
