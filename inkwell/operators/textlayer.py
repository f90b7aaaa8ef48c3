"""Text layer: boxes of text items, turns, lines, folios, and pages that look like an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import columns as C

PAGE = ["doc_id", "page_number"]


def upright_items(raw: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Non-blank, upright items with normalised boxes along their own baseline; from (str, transform, width, height)."""
    t = F.col("transform")
    kept = raw.where((F.trim(F.regexp_replace("str", r"\s", " ")) != "") & (C.quarter_turns(F.get(t, 0), F.get(t, 1)) == 0))
    box = C.text_box(t, F.col("width"), F.col("height"), page_w, page_h)
    return kept.select(*PAGE, "item_ord", "str", *(b.alias(n) for b, n in zip(box, "xywh")))


def sideways_turns(raw: DataFrame) -> DataFrame:
    """(doc_id, page_number, turn) for turns 1 to 3 that hold enough of a page's characters."""
    t = F.col("transform")
    n = F.length(F.regexp_replace("str", r"\s+", ""))
    turned = raw.where(t.isNotNull() & F.col("str").isNotNull()).groupBy(*PAGE, C.quarter_turns(F.get(t, 0), F.get(t, 1)).alias("turn")).agg(F.sum(n).alias("n"))
    total = turned.groupBy(*PAGE).agg(F.sum("n").alias("total"))
    keep = (F.col("turn") > 0) & (F.col("n") >= CONFIG.rotated_text_min_chars) & (F.col("n") >= CONFIG.rotated_text_min_share * F.col("total"))
    return turned.join(total, PAGE).where(keep).select(*PAGE, "turn", "n")


def top_of(rows: Column, y0: Column) -> Column:
    """The items of ``rows`` (structs x, item_ord, s, y) within a small band below ``y0``, left to right; null if there is none."""
    near = F.array_sort(F.filter(rows, lambda i: i["y"] - y0 < CONFIG.index_top_line_tolerance))
    return F.when(F.size(near) > 0, F.array_join(F.transform(near, lambda i: i["s"]), " "))


def top_item() -> Column:
    return F.struct("x", "item_ord", F.trim("str").alias("s"), "y")


def top_lines(items: DataFrame) -> DataFrame:
    """(page, top): the items within a small band below the topmost one, left to right."""
    rows = items.groupBy(*PAGE).agg(F.collect_list(top_item()).alias("rows"), F.min("y").alias("y0"))
    return rows.select(*PAGE, top_of(F.col("rows"), F.col("y0")).alias("top")).where("top is not null")


def fold_lines(y: np.ndarray, tol: float) -> np.ndarray:
    """The number of each item's line, for items in the order of y: a line keeps its first y, and an item within tol of it joins."""
    return fold_pages(y, np.array([0, len(y)]), np.array([tol]))


def fold_pages(y: np.ndarray, edge: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """The same for the items of many pages, the k-th at edge[k] to edge[k + 1]; numbers go on from page to page."""
    line, at = [], -1
    values, edges = y.tolist(), edge.tolist()
    for a, b, t in zip(edges, edges[1:], tol.tolist()):
        first = None
        for v in values[a:b]:
            if first is None or not abs(v - first) <= t:
                at, first = at + 1, v
            line.append(at)
    return np.array(line, np.int64)


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages with their items (y, x, ord, s) in order and a tolerance: the last two columns; the others go through. A batch is one call, in which every item is looked at once."""
    for batch in batches:
        lists, tol = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        edge = lists.offsets.to_numpy().astype(np.int64)
        flat, edge = lists.flatten(), edge - edge[0]
        y, x, order = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "ord"))
        line = fold_pages(y, edge, tol.to_numpy(zero_copy_only=False))
        by_x = np.lexsort((order, x, line))
        text = flat.field("s").take(pa.array(by_x))
        said = text.is_valid().to_numpy(zero_copy_only=False).astype(bool)
        n = int(line[-1]) + 1 if len(line) else 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(line[said], minlength=n))]).astype(np.int32)  # lines ascend, so by_x keeps them in place
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text.drop_null()), " ")
        last = np.where(np.diff(edge) > 0, line[np.maximum(edge[1:] - 1, 0)] + 1 if len(line) else 0, 0)
        pages = np.concatenate([[0], np.maximum.accumulate(last)]).astype(np.int32)
        kept = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(pa.array(pages), joined)], [*kept, "lines"])


# Fixed value: a line that ends in a page number, a range or a number with a suffix.
ENDS_IN_NUMBER = r"\d+(?:\s*[–—-]\s*\d+)?(?:f|ff|n)?\s*$"


def inner(y: Column, h: Column) -> Column:
    """Within the margins."""
    m = CONFIG.page_number_margin
    return (y >= m) & (y + h <= 1 - m)


def line_item() -> Column:
    """An item as the kernel of lines takes it."""
    return F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("item_ord").cast("long").alias("ord"), F.col("str").alias("s"), F.col("h").alias("h"))


def lines_of(pages: DataFrame, others: dict[str, str]) -> DataFrame:
    """The columns ``others`` (names and types) of pages, and ``lines``: the text lines of their ``rows``, which are unordered arrays of ``line_item``."""
    med = C.upper_median(F.transform("rows", lambda i: i["h"]))
    tol = (0.5 * F.when(med == 0, 0.01).otherwise(med)).cast("double")
    item = lambda i: F.struct(*(i[c].alias(c) for c in ("y", "x", "ord", "s")))
    sent = pages.select(*(F.col(c).cast(k).alias(c) for c, k in others.items()), F.array_sort(F.transform("rows", item)).alias("rows"), tol.alias("tol"))
    return sent.mapInArrow(_page_lines, ", ".join(f"{c} {k}" for c, k in others.items()) + ", lines array<string>")


def page_lines(items: DataFrame) -> DataFrame:
    """(page, lines): the text lines within the margins."""
    rows = items.where(inner(F.col("y"), F.col("h"))).groupBy(*PAGE).agg(F.collect_list(line_item()).alias("rows"))
    return lines_of(rows, {c: "long" for c in PAGE})


def enough_refs(lines: Column) -> tuple[Column, Column, Column]:
    """Of a page's lines: how many there are, how many end in a page number, and whether these are enough for an index."""
    n, refs = F.size(lines), F.size(F.filter(lines, lambda s: s.rlike(ENDS_IN_NUMBER)))
    return n, refs, (refs >= CONFIG.index_fallback_min_lines) & (refs >= CONFIG.index_fallback_min_share * n)


def index_like(items: DataFrame) -> DataFrame:
    """Pages of which enough lines end in a page number."""
    n, refs, enough = enough_refs(F.col("lines"))
    return page_lines(items).select(*PAGE, n.alias("n"), refs.alias("refs"), enough.alias("enough")).where("enough").drop("enough")


def printed_numbers(items: DataFrame) -> DataFrame:
    """Distinct (page, printed): lone numbers in the top or bottom margin."""
    m, s = CONFIG.page_number_margin, F.trim("str")
    folio = s.rlike(r"^\d{1,4}$") & ((F.col("y") < m) | (F.col("y") + F.col("h") > 1 - m))
    return items.where(folio).select(*PAGE, s.try_cast("long").alias("printed")).distinct()
