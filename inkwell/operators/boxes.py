"""Boxes on pages: gates, proximity clusters, de-duplication and reading order.

Order-dependent steps are kernels over one page's boxes, after a single shuffle
by page; the search runs the same kernels where it finds the matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import columns as C
from ..functions import kernels as K


def gated(candidates: DataFrame, anchors: DataFrame, template_h: float) -> DataFrame:
    """Candidates (page, ord, w, h, ink) joined to the anchors (anchor, aw, ah, adensity) that they may show. At most three anchors, so their side is broadcast."""
    test = C.gate(F.col("w"), F.col("h"), F.col("ink"), F.col("aw"), F.col("ah"), F.col("adensity"), F.lit(template_h))
    return candidates.join(F.broadcast(anchors), test)


def placements(gates: DataFrame) -> DataFrame:
    """The scales and offsets to try for each gated candidate: columns s (index), scale, dy, dx."""
    s0 = (F.col("h") / F.col("ah") + F.col("w") / F.col("aw")) / 2
    scaled = gates.select("*", F.posexplode(C.refined_scales(s0)).alias("s", "scale"))
    step = F.array(*(F.lit(k) for k in range(-CONFIG.jitter_px, CONFIG.jitter_px + 1)))
    return scaled.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step))


def proximity_clusters(boxes: DataFrame, gap: int = CONFIG.cluster_gap_px) -> DataFrame:
    """(page, x0, y0, x1, y1, ink, members) of groups of near boxes.

    Pages become rows with their boxes as a list; a batch of pages is one kernel
    call, with the pages laid side by side too far apart to touch.
    """
    names = ["x", "y", "x1", "y1", "ink"]
    listed = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", *(F.col(c).cast("long").alias(c) for c in names)))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, lists = batch.column(0), batch.column(1)
            flat = lists.flatten()
            t = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            low = int(t[:, 0].min(initial=0))
            step = int(t[:, 2].max(initial=0)) - low + gap + 2
            shift = owner * step
            t[:, 0] += shift - low
            t[:, 2] += shift - low
            out = K.clusters(t, gap)
            at = out[:, 0] // step
            out[:, 0] += low - at * step
            out[:, 2] += low - at * step
            yield pa.RecordBatch.from_arrays([pages.take(pa.array(at)), *(pa.array(out[:, k]) for k in range(6))], ["page", *K.BOX, "members"])

    return listed.mapInArrow(run, "page long, x0 long, y0 long, x1 long, y1 long, ink long, members long")


def _per_page(rows: DataFrame, names: list[str], kernel, schema: str) -> DataFrame:
    """``kernel`` over the boxes of each page, from arrays of doubles by name to equally long lists by column; a batch holds many pages."""
    listed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", *(F.col(c).cast("double").alias(c) for c in names)))).alias("b"))
    out = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edge = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
            edge = edge - edge[0]
            cols = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ["ord", *names]}
            found = [kernel({c: v[a:b] for c, v in cols.items()}) for a, b in zip(edge, edge[1:])]
            pages = np.repeat(batch.column(0).to_numpy(), [len(f[out[0]]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(pages), *(pa.array(np.concatenate([f[c] for f in found]).astype(_KINDS[kind])) for c, kind in (x.split() for x in schema.split(", ")))], ["page", *out])

    return listed.mapInArrow(run, f"page long, {schema}")


_KINDS = {"long": np.int64, "double": float}


def dedupe(matches: DataFrame, iou: float = CONFIG.dedupe_iou) -> DataFrame:
    """Best score first; a match that overlaps a kept one by more than ``iou`` goes. Ties keep the order of ``ord``. The kernel is that of the search."""

    def kernel(t: dict) -> dict:
        k = K.dedupe(t["x"], t["y"], t["w"], t["h"], t["score"], t["ord"], iou)
        return {"rank": np.arange(len(k)), **{c: t[c][k] for c in ("ord", "x", "y", "w", "h", "score")}}

    return _per_page(matches, ["x", "y", "w", "h", "score"], kernel, "rank long, ord long, x double, y double, w double, h double, score double")


def reading_order(matches: DataFrame) -> DataFrame:
    """Adds ``line`` and ``reading_ord``: a match joins the last line if its centre is near the line's first centre. The kernel is that of the search."""

    def kernel(t: dict) -> dict:
        k, line = K.reading_order(t["x"], t["y"], t["h"], t["ord"])
        return {"reading_ord": np.arange(1, len(k) + 1), "line": line[k], "ord": t["ord"][k]}

    return _per_page(matches, ["x", "y", "h"], kernel, "reading_ord long, line long, ord long")


#: Side of the cells of a page by which windows meet components: several times a window's height, so that its reach touches few of them.
CELL_PX = 128


def attached_pairs(windows: DataFrame, comps: DataFrame, side: int = CELL_PX, also: tuple[str, ...] = ()) -> DataFrame:
    """Windows (page, ord, x, y, w, h) with the components beside them that count as scripts or accents; shape tests of commas apart.

    A window looks for upper left corners within its reach: to the left by an accent's width, to the right by a
    script's gap, up by a script's height or an accent's with its gap, and down by the gap. It is put into the cells of the page
    that its reach touches, a component into the one of its corner, so that only neighbours are compared.
    Columns ``also`` of the components go along.
    """
    cfg, col = CONFIG, F.col
    c = comps.select("page", col("ord").alias("comp"), col("x").alias("x0"), col("y").alias("y0"), col("x1").alias("cx1"), col("y1").alias("cy1"), *also)
    c = c.withColumns({"cell_x": F.floor(col("x0") / side), "cell_y": F.floor(col("y0") / side)})
    up = max(cfg.script_max_height, cfg.accent_max_height + cfg.accent_max_gap)
    left, right = col("x") - F.greatest(F.lit(1.0), cfg.accent_max_width * col("w")), col("x") + col("w") + F.greatest(F.lit(0.0), cfg.script_max_gap * col("h"))
    top, low = col("y") - up * col("h") - 2, col("y") + col("h") + cfg.accent_max_gap * col("h") + 1
    cells = lambda a, b: F.sequence(F.floor(a / side), F.floor(b / side))
    reach = windows.select("page", "ord", "x", "y", "w", "h", F.explode(cells(left, right)).alias("cell_x"), top.alias("top"), low.alias("low"))
    reach = reach.withColumn("cell_y", F.explode(cells(col("top"), col("low")))).drop("top", "low")
    args = [col(k) for k in ("x0", "y0", "cx1", "cy1", "x", "y", "w", "h")]
    script, accent = C.script_kind(*args), C.is_accent(*args)
    same = (col("w.page") == col("c.page")) & (col("w.cell_x") == col("c.cell_x")) & (col("w.cell_y") == col("c.cell_y"))
    both = reach.alias("w").join(c.alias("c"), same & (col("ord") != col("comp")) & (script.isNotNull() | accent))
    return both.select("w.page", "ord", "comp", script.alias("script"), accent.alias("accent"), *also)


def punctuation_shapes(rows: DataFrame) -> DataFrame:
    """Per component, from its pixel rows (comp, w, h, y, span, ink; y from 0): is it comma-shaped?"""
    cfg = CONFIG
    head = F.col("y") < F.greatest(F.lit(1), C.half_up(cfg.punct_head_fraction * F.col("h")))
    most = lambda c: F.coalesce(F.max(F.when(c, F.col("span"))), F.lit(0))
    shape = rows.groupBy("comp", "w", "h").agg(
        most(head).alias("head_max"), most(~head).alias("rest_max"), most(F.col("y") >= F.ceil(F.col("h") / 2)).alias("tail_max"), F.sum(F.when(head, F.col("ink")).otherwise(0)).alias("head_ink"), F.sum(F.when(head, F.col("span")).otherwise(0)).alias("head_span")
    )
    comma = (
        (F.col("w") <= cfg.punct_max_aspect * F.col("h"))
        & (F.col("head_max") >= F.col("rest_max"))
        & (F.col("head_max") >= cfg.punct_head_min_width * F.col("w"))
        & (F.col("head_ink") >= cfg.punct_head_solidity * F.col("head_span"))
        & (F.col("tail_max") <= cfg.punct_tail_max_width * F.col("w"))
    )
    return shape.withColumn("comma", comma)


def anchor_pieces(pieces: DataFrame) -> DataFrame:
    """The largest piece of each page and further ones with enough ink, at most three; ``k`` is their place."""
    w = Window.partitionBy("page").orderBy(F.desc("ink"), "ord")
    ranked = pieces.withColumn("k", F.row_number().over(w)).where(F.col("k") <= CONFIG.max_anchors).withColumn("largest", F.max("ink").over(Window.partitionBy("page")))
    return ranked.where((F.col("k") == 1) | (F.col("ink") >= CONFIG.anchor_min_ink_ratio * F.col("largest"))).drop("largest")
