"""The stored page index: what a search needs of a page, in compact columns, and searches over it.

A page is analysed once, when it is stored. A search reads the boxes of a page's
components and clusters as columns and drops, by expressions over them, every page on
which no candidate passes the gate; only pages that are left have their runs expanded to
pixels. Candidates of many templates are found by one hash join over cells of size,
shape and density. Nothing here shuffles pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import codec
from ..functions import columns as C
from ..functions import kernels as K
from ..schemas import STORED_PAGE
from . import search as S
from .raster import one_list

BOXES = [*K.BOX]
GROUPS = [*K.BOX, "members"]


def stored_index(images: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Rows of STORED_PAGE for IMAGE rows; a page that cannot be analysed has an ``error`` and nothing else."""
    own = [c for c in ("turns",) if c in images.columns]

    def row(page: int, w, h, bits) -> list[pa.Array]:
        error, runs, boxes, groups = None, None, np.zeros((0, 5), np.int64), np.zeros((0, 6), np.int64)
        try:
            image = np.frombuffer(bits, np.uint8).reshape(h, w)
            found, boxes, groups = K.analyse(image, cfg)
            runs = codec.pack_runs(found, h)
        except Exception as e:  # a page that fails becomes a row, and the others go on
            error = f"{type(e).__name__}: {e}"
        return [pa.array([page], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([runs], pa.binary()), one_list(list(boxes.T), BOXES), one_list(list(groups.T), GROUPS), pa.array([error], pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                cols = row(*(at[c][r].as_py() for c in ("page", "w", "h", "bits")))
                yield pa.RecordBatch.from_arrays([*cols, *(at[c].slice(r, 1) for c in own)], ["page", "w", "h", "runs", "comps", "clusters", "error", *own])

    return images.select("page", "w", "h", "bits", *own).mapInArrow(run, STORED_PAGE + "".join(f", {c} array<int>" for c in own))


def anchor_rows(template: K.Template) -> list[tuple[int, int, float]]:
    """(width, height, density) of each anchor."""
    return [(int(a[2] - a[0] + 1), int(a[3] - a[1] + 1), float(a[4]) / float((a[2] - a[0] + 1) * (a[3] - a[1] + 1))) for a in template.anchors]


def gates(template: K.Template) -> list[Callable[[Column], Column]]:
    """For each anchor a test of boxes, as expressions."""

    def of(aw: int, ah: int, density: float) -> Callable[[Column], Column]:
        return lambda b: C.gate(C.box_size(b["x0"], b["x1"]), C.box_size(b["y0"], b["y1"]), b["ink"], F.lit(aw), F.lit(ah), F.lit(density), F.lit(template.image.shape[0]), template.cfg)

    return [of(*row) for row in anchor_rows(template)]


def gate_counts(store: DataFrame, template: K.Template) -> DataFrame:
    """(page, candidates, gated): pairs of anchors and candidates of each page that is not too dense, and those that pass the gate."""
    pages = store.where(F.col("error").isNull() & (F.size("comps") <= template.cfg.max_page_components))
    both = (F.size("comps") + F.size("clusters")) * len(template.anchors)
    gated = reduce(add, (F.size(F.filter(boxes, test)) for boxes in ("comps", "clusters") for test in gates(template)))
    return pages.select("page", both.cast("long").alias("candidates"), gated.cast("long").alias("gated"))


def gated_pages(store: DataFrame, template: K.Template, turns: tuple[int, ...] = (0,)) -> DataFrame:
    """The pages that some turn of the template may be on; pages with turns of their own are held against all."""
    every = turns if "turns" not in store.columns else (0, 1, 2, 3)
    tests = [test for k in dict.fromkeys(k % 4 for k in every) for test in gates(K.rotate(template, k))]
    some = reduce(or_, (F.exists(boxes, test) for boxes in ("comps", "clusters") for test in tests))
    return store.where(F.col("error").isNull() & (F.size("comps") <= template.cfg.max_page_components) & some)


def page_of(w: int, h: int, runs: bytes, comps: np.ndarray, clusters: np.ndarray) -> K.Page:
    """A page ready for matching, from what is stored."""
    return K.Page(K.image_of(codec.unpack_runs(runs, h), w, h), comps, clusters)


def struct_table(column: pa.Array, row: int, names: list[str]) -> np.ndarray:
    """One row of a column of lists of structs, as a table."""
    flat = column[row].values
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(np.int64) if len(flat) else np.zeros((0, len(names)), np.int64)


def _search(store: DataFrame, template: K.Template, step: str, threshold: float, turns: tuple[int, ...], keep_gate: bool = True, **options) -> DataFrame:
    own = "turns" in store.columns
    pages = gated_pages(store, template, turns) if keep_gate and not options.get("keep_all") else store.where("error is null")

    def loaded(at: dict[str, pa.Array], r: int) -> K.Page:
        return page_of(at["w"][r].as_py(), at["h"][r].as_py(), at["runs"][r].as_py(), struct_table(at["comps"], r, BOXES), struct_table(at["clusters"], r, GROUPS))

    found = S.match_rows(pages.select("page", "w", "h", "runs", "comps", "clusters", *(["turns"] if own else [])), loaded, template, step, threshold, turns=turns, **options)
    failed = store.where("error is not null")
    empty = [F.lit(None).cast(t).alias(c) if c not in ("page", "error") else F.col(c) for c, t in found.dtypes]
    return found.unionByName(failed.select(*empty))


def search_store(store: DataFrame, template: K.Template, threshold: float = CONFIG.search_floor, turns: tuple[int, ...] = (0,), **options) -> DataFrame:
    """Rows of MATCH from a stored index, as ``search.search_pages`` gives from images: pages that failed have an ``error``."""
    return _search(store, template, "read", threshold, turns, **options)


def stored_matches(store: DataFrame, template: K.Template, threshold: float = CONFIG.search_floor, turns: tuple[int, ...] = (0,), **options) -> DataFrame:
    """Rows of MATCH."""
    return search_store(store, template, threshold, turns, **options).where("error is null").drop("error")


def expand_store(store: DataFrame) -> DataFrame:
    """IMAGE rows back from a stored index; pages that failed have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                image = K.image_of(codec.unpack_runs(r["runs"], r["h"]), r["w"], r["h"])
                yield pa.RecordBatch.from_arrays([pa.array([r["page"]], pa.int64()), pa.array([r["w"]], pa.int32()), pa.array([r["h"]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["page", "w", "h", "bits"])

    return store.where("error is null").select("page", "w", "h", "runs").mapInArrow(run, "page long, w int, h int, bits binary")


def run_rows(store: DataFrame) -> DataFrame:
    """(page, w, h, y, x0, x1): the runs of stored pages as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = codec.unpack_runs(r["runs"], r["h"])
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), v), k) for v, k in ((r["page"], pa.int64()), (r["w"], pa.int32()), (r["h"], pa.int32()))] + [pa.array(t[:, k]) for k in range(3)], ["page", "w", "h", "y", "x0", "x1"])

    return store.where("error is null").select("page", "w", "h", "runs").mapInArrow(run, "page long, w int, h int, y long, x0 long, x1 long")


def stored_bytes(store: DataFrame) -> DataFrame:
    """(page, bytes): what a page takes with its boxes in differences as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            size = [len(at["runs"][r].as_py()) + len(codec.pack_boxes(struct_table(at["comps"], r, BOXES))) + len(codec.pack_boxes(struct_table(at["clusters"], r, GROUPS))) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([at["page"], pa.array(size, pa.int64())], ["page", "bytes"])

    return store.where("error is null").select("page", "runs", "comps", "clusters").mapInArrow(run, "page long, bytes long")


# regions, cut from runs


def cut_runs(index: DataFrame, regions: DataFrame, factor: int = 2, cfg: Config = CONFIG) -> DataFrame:
    """(page, region, w, h, runs, error): the parts of indexed pages (rows of PAGE_INDEX) that the boxes of ``regions`` (page, region, x, y, w, h, as shares of the page) cover, ``factor`` times as large.

    ``runs`` has structs y, x0, x1 in pixels of the cut, before it is enlarged. They are
    clipped as arrays; no raster is made. A region off its page, or one that would exceed the limit of
    pixels, has an error and no runs.
    """
    both = index.select("page", F.col("w").alias("page_w"), F.col("h").alias("page_h"), "row_start", F.col("runs").alias("all")).join(regions.select("page", "region", "x", "y", "w", "h"), "page")
    left, top = F.greatest(F.lit(0), F.floor(F.col("x") * F.col("page_w"))), F.greatest(F.lit(0), F.floor(F.col("y") * F.col("page_h")))
    right, low = F.least(F.col("page_w"), F.ceil((F.col("x") + F.col("w")) * F.col("page_w"))), F.least(F.col("page_h"), F.ceil((F.col("y") + F.col("h")) * F.col("page_h")))
    cut = both.select("page", "region", "row_start", "all", *(c.cast("int").alias(n) for c, n in ((left, "x0"), (top, "y0"), (right, "x1"), (low, "y1"))))
    size = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a)) * factor
    cut = cut.withColumns({"w": size("x0", "x1"), "h": size("y0", "y1")})
    cut = cut.withColumn("error", F.when((F.col("w") == 0) | (F.col("h") == 0), "off the page").when(F.col("w").cast("long") * F.col("h") > cfg.max_snip_pixels, "too large"))
    rows = F.sequence(F.col("y0"), F.col("y1") - 1)  # of the page, so that only the runs of these rows are looked at

    def of_row(y: Column) -> Column:
        first = F.get("row_start", y)
        mine = F.slice("all", first + 1, F.get("row_start", y + 1) - first)
        clipped = F.transform(mine, lambda r: F.struct((y - F.col("y0")).alias("y"), (F.greatest(r["x0"], F.col("x0")) - F.col("x0")).alias("x0"), (F.least(r["x0"] + r["len"], F.col("x1")) - 1 - F.col("x0")).alias("x1")))
        return F.filter(clipped, lambda r: r["x0"] <= r["x1"])

    runs = F.when(F.col("error").isNull(), F.flatten(F.transform(rows, of_row)))
    return cut.select("page", "region", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), runs.alias("runs"), "error")


# candidates of many templates


def template_table(images: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(template_id, w, h, ink, bits, anchors): a template of each image, cut to its ink; images without ink, or that fail, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .raster import images_of

        for batch in batches:
            for page, image in images_of(batch):
                t = K.prepare_template(image, cfg)
                if t is not None:
                    h, w = t.image.shape
                    fixed = [pa.array([v], k) for v, k in ((page, pa.int64()), (w, pa.int32()), (h, pa.int32()), (int(t.image.sum()), pa.int32()), (t.image.tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*fixed, one_list(list(t.anchors.T), BOXES)], ["template_id", "w", "h", "ink", "bits", "anchors"])

    return images.select("page", "w", "h", "bits").mapInArrow(run, "template_id long, w int, h int, ink int, bits binary, anchors array<struct<x0:int,y0:int,x1:int,y1:int,ink:int>>")


def scaled_templates(templates: DataFrame, keys: list[int], cfg: Config = CONFIG) -> DataFrame:
    """(template_id, scale_key, w, h, ink, bits, distance) of each row of ``template_table`` at each scale of a hundredth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = K.Template(np.frombuffer(r["bits"], np.uint8).reshape(r["h"], r["w"]), np.array([[a[c] for c in BOXES] for a in r["anchors"]]), cfg)
                for key in keys:
                    s = t.at(key)
                    h, w = s.image.shape
                    values = (r["template_id"], key, w, h, int(s.image.sum()), s.image.tobytes(), s.dist.tobytes())
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["template_id", "scale_key", "w", "h", "ink", "bits", "distance"])

    return templates.mapInArrow(run, "template_id long, scale_key int, w int, h int, ink int, bits binary, distance binary")


def candidate_rows(store: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(page, cand, x0, y0, w, h, ink): components, then clusters, of pages that are not too dense, numbered from 0."""
    pages = store.where(F.col("error").isNull() & (F.size("comps") <= cfg.max_page_components))
    bare = lambda c: F.transform(c, lambda b: F.struct(*(b[k].alias(k) for k in BOXES)))
    rows = pages.select("page", F.posexplode(F.concat(bare("comps"), bare("clusters"))).alias("cand", "b"))
    return rows.select("page", "cand", "b.x0", "b.y0", C.box_size(F.col("b.x0"), F.col("b.x1")).alias("w"), C.box_size(F.col("b.y0"), F.col("b.y1")).alias("h"), "b.ink")


#: Cells of the logarithms of height, aspect and density.
CELLS = {"height": 1.3, "aspect": 0.3, "density": 0.6}
SLACK = 1e-9


def cell(value: Column, name: str) -> Column:
    return F.floor(F.log(value) / CELLS[name]).cast("int")


def cells_within(value: Column, low: float, high: float, name: str) -> Column:
    """The cells that value * low to value * high touch."""
    at = lambda f, slack: F.floor((F.log(value) + np.log(f)) / CELLS[name] + slack).cast("int")
    return F.sequence(at(low, -SLACK), at(high, SLACK))


def gated_candidates(candidates: DataFrame, templates: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(template_id, anchor, page, cand): the candidates (page, cand, w, h, ink) that pass the gate of an anchor of ``templates`` (template_id, h, anchors).

    The gate bounds the ratios of heights, aspects and densities, so that in cells of their
    logarithms an anchor has a few neighbours: it is put into each of these cells, a
    candidate into its own, and the gate is tested within the cells only.
    """
    anchors = templates.select("template_id", F.col("h").alias("th"), F.posexplode("anchors").alias("anchor", "a"))
    aw, ah = C.box_size(F.col("a.x0"), F.col("a.x1")), C.box_size(F.col("a.y0"), F.col("a.y1"))
    anchors = anchors.select("template_id", "th", "anchor", aw.alias("aw"), ah.alias("ah"), C.density(F.col("a.ink"), aw, ah).alias("ad"))
    near = {
        "height": cells_within(F.col("ah"), cfg.scale_min, cfg.scale_max, "height"),
        "aspect": cells_within(F.col("aw") / F.col("ah"), 1 - cfg.scale_asymmetry_max, 1 + cfg.scale_asymmetry_max, "aspect"),
        "density": cells_within(F.col("ad"), 1 - cfg.density_tolerance, 1 + cfg.density_tolerance, "density"),
    }
    for name, cells in near.items():
        anchors = anchors.withColumn(name, F.explode(cells))
    own = {"height": F.col("h"), "aspect": F.col("w") / F.col("h"), "density": C.density(F.col("ink"), F.col("w"), F.col("h"))}
    placed = candidates.select("page", "cand", F.col("w").alias("cw"), F.col("h").alias("ch"), F.col("ink").alias("cink"), *(cell(v, k).alias(f"c_{k}") for k, v in own.items()))
    gate = C.gate(F.col("cw"), F.col("ch"), F.col("cink"), F.col("aw"), F.col("ah"), F.col("ad"), F.col("th"), cfg)
    same = reduce(lambda a, b: a & b, (F.col(f"c_{k}") == F.col(k) for k in CELLS))
    return placed.join(anchors, same & gate).select("template_id", "anchor", "page", "cand")
