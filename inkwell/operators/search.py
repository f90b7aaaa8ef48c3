"""Page search: a template matched against pages, best placements de-duplicated and put in reading order.

All of it is one kernel over one page at a time, which never leaves its
partition, so a search has no shuffle. The template is one small object and
travels with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import columns as C
from ..functions import kernels as K
from ..schemas import MATCH, MATCH_PX

COLUMNS = ["x", "y", "w", "h", "score", "forward", "reverse", "scale"]


def loaded_image(at: dict[str, pa.Array], r: int, cfg: Config) -> K.Page:
    """An IMAGE row, analysed."""
    w, h, bits = (at[c][r].as_py() for c in ("w", "h", "bits"))
    image = np.frombuffer(bits, np.uint8).reshape(h, w)
    return K.Page(image, *K.analyse(image, cfg)[1:])


#: What a page's kernel counts: pairs of anchors and candidates, those that pass the gate, placements, and those that the bound spares.
STATS = ["candidates", "gated", "scored", "pruned"]


def match_rows(pages: DataFrame, load: Callable[[dict[str, pa.Array], int], K.Page], template: K.Template, step: str, threshold: float, attached_ink: bool = True, turns: tuple[int, ...] = (0,), keep_all: bool = False) -> DataFrame:
    """Matches after a step: "raw", "kept" (de-duplicated, with ``rank``), "read" (in reading order, normalised), "stats" (STATS of each page in place of matches), or "watched" (a row of STATS before the rows of "read").

    ``load`` makes a page of a row. A page's own ``turns``, if there is such a column, go before those of the search.
    """
    own = "turns" in pages.columns
    schema = {"raw": MATCH_PX, "kept": MATCH_PX + ", rank int", "read": MATCH, "stats": "page long, " + ", ".join(f"{c} long" for c in STATS), "watched": MATCH + "".join(f", {c} long" for c in STATS)}[step] + ", error string"
    kinds = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")]

    def page_rows(data: K.Page, asked: tuple[int, ...], cache: dict[int, K.Template]) -> list[dict[str, np.ndarray]]:
        """Tables of columns, one after the other."""
        cfg = template.cfg
        if len(data.boxes) > cfg.max_page_components:
            return []
        for k in asked:
            if k not in cache:
                cache[k] = K.rotate(template, k)
        total = dict.fromkeys(STATS, 0)
        parts = []
        for k in asked:
            stats: dict[str, int] = {}
            parts.append(K.match_page(cache[k], data, threshold, attached_ink, keep_all, stats))
            total = {c: n + stats.get(c, 0) for c, n in total.items()}
        counts = {c: np.array([n]) for c, n in total.items()}
        if step == "stats":
            return [counts]
        rows = np.concatenate(parts or [np.zeros((0, 8))])
        t = {c: rows[:, k] for k, c in enumerate(COLUMNS)} | {"ord": np.arange(len(rows))}
        if step == "raw":
            return [t]
        k = K.dedupe(*(t[c] for c in ("x", "y", "w", "h", "score", "ord")), cfg.dedupe_iou)
        t = {c: v[k] for c, v in t.items()} | {"rank": np.arange(len(k))}
        if step == "kept":
            return [t]
        k, _ = K.reading_order(t["x"], t["y"], t["h"], t["rank"])
        h, w = data.image.shape
        shares = C.normalised(*(t[c][k] for c in ("x", "y", "w", "h")), w, h)
        found = {"reading_ord": np.arange(1, len(k) + 1), **dict(zip(("x_norm", "y_norm", "w_norm", "h_norm"), shares)), "score": t["score"][k]}
        return [counts, found] if step == "watched" else [found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, K.Template] = {}
        for batch in batches:
            at = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                error = None
                try:
                    asked = at["turns"][r].as_py() if own else None
                    tables = page_rows(load(at, r), tuple(turns if asked is None else asked), cache)
                except Exception as e:  # a page that fails becomes a row, and the others go on
                    error, tables = f"{type(e).__name__}: {e}", [{}]
                for t in tables:
                    n = len(next(iter(t.values()))) if t else 1
                    if n:
                        fixed = {"page": np.full(n, at["page"][r].as_py(), np.int64)}
                        cols = [pa.array(fixed.get(c, t.get(c)).astype(kind.to_pandas_dtype()), kind) if c in fixed or c in t else pa.array([error] * n if c == "error" else [None] * n, kind) for c, kind in kinds]
                        yield pa.RecordBatch.from_arrays(cols, [c for c, _ in kinds])

    return pages.mapInArrow(run, schema)


def _found(images: DataFrame, template: K.Template, step: str, threshold: float, **options) -> DataFrame:
    own = ["turns"] if "turns" in images.columns else []
    return match_rows(images.select("page", "w", "h", "bits", *own), lambda at, r: loaded_image(at, r, template.cfg), template, step, threshold, **options)


def match_statistics(images: DataFrame, template: K.Template, threshold: float = CONFIG.search_floor, **options) -> DataFrame:
    """(page, candidates, gated, scored, pruned, error) of a search, as its kernel counts them."""
    return _found(images, template, "stats", threshold, **options)


def search_observed(images: DataFrame, template: K.Template, observation: Observation, threshold: float = CONFIG.search_floor, **options) -> DataFrame:
    """Rows of ``search_pages``; the one pass over the pages that gives them also fills the observation with the sums of STATS, and with ``matches``, ``pages`` and ``failed``."""
    rows = _found(images, template, "watched", threshold, **options)
    found, counted = F.col("reading_ord").isNotNull(), F.col("candidates").isNotNull()
    seen = rows.observe(observation, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS), F.count_if(found).alias("matches"), F.count_if(counted).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return seen.where(~counted).drop(*STATS)


def raw_matches(images: DataFrame, template: K.Template, threshold: float = CONFIG.similarity_threshold, **options) -> DataFrame:
    """Rows of MATCH_PX before de-duplication, numbered in the order (turn, anchor, candidate)."""
    return _found(images, template, "raw", threshold, **options).where("error is null").drop("error")


def find_matches(images: DataFrame, template: K.Template, threshold: float = CONFIG.similarity_threshold, **options) -> DataFrame:
    """De-duplicated matches in page pixels, with their rank by score."""
    return _found(images, template, "kept", threshold, **options).where("error is null").drop("error")


def page_matches(images: DataFrame, template: K.Template, threshold: float = CONFIG.search_floor, **options) -> DataFrame:
    """Rows of MATCH: matches of each page in reading order, normalised by the page's size."""
    return search_pages(images, template, threshold, **options).where("error is null").drop("error")


def search_pages(images: DataFrame, template: K.Template, threshold: float = CONFIG.search_floor, **options) -> DataFrame:
    """Rows of MATCH, and one with an ``error`` for each page that failed."""
    return _found(images, template, "read", threshold, **options)


def with_turns(images: DataFrame, pages: DataFrame, turned: DataFrame) -> DataFrame:
    """Images with ``turns`` to search: upright, and those that the text layer of the page shows. ``pages`` maps a raster's page to (doc_id, page_number), ``turned`` has (doc_id, page_number, turn)."""
    each = turned.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_set(F.col("turn").cast("int"))).alias("t"))
    mine = pages.join(each, ["doc_id", "page_number"]).select("page", "t")
    return images.join(mine, "page", "left").withColumn("turns", F.concat(F.array(F.lit(0)), F.coalesce("t", F.array().cast("array<int>")))).drop("t")


def scan_report(images: DataFrame) -> DataFrame:
    """(page, components, dense, error): pages too dense to be searched, and pages whose raster is broken; others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, error = None, None
                try:
                    image = np.frombuffer(r["bits"], np.uint8).reshape(r["h"], r["w"])
                    n = len(K.components(K.find_runs(image), r["w"], CONFIG.min_cc_pixels)[0])
                except Exception as e:  # whatever is wrong with a page shows in its row
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([r["page"]], pa.int64()), pa.array([n], pa.int64()), pa.array([n is not None and n > CONFIG.max_page_components]), pa.array([error], pa.string())], ["page", "components", "dense", "error"])

    return images.select("page", "w", "h", "bits").mapInArrow(run, "page long, components long, dense boolean, error string")


def shown(matches: DataFrame, min_score: float = CONFIG.similarity_threshold) -> DataFrame:
    """The display filter over stored matches; no page is searched again."""
    return matches.where(F.col("score") >= min_score)


def page_counts(matches: DataFrame, min_score: float = CONFIG.similarity_threshold) -> DataFrame:
    """(page, n, shown): matches of each page, and those that are shown."""
    return matches.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= min_score).alias("shown"))


def summary(matches: DataFrame, report: DataFrame, min_score: float = CONFIG.similarity_threshold) -> DataFrame:
    """One row: shown matches and their pages, weaker candidates, dense and failed pages."""
    good = F.col("score") >= min_score
    m = matches.agg(F.count_if(good).alias("n_shown"), F.count_distinct(F.when(good, F.col("page"))).alias("n_pages"), F.count_if(~good).alias("n_weaker"))
    r = report.agg(F.count_if("dense").alias("n_dense"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return m.join(r)  # one row each


def template_from_region(image: np.ndarray, x: int, y: int, w: int, h: int) -> K.Template | None:
    """A template cut from a page at its own scale."""
    H, W = image.shape
    x0, y0, x1, y1 = max(0, x), max(0, y), min(W, x + w), min(H, y + h)
    return K.prepare_template(image[y0:y1, x0:x1].copy()) if x1 > x0 and y1 > y0 else None
