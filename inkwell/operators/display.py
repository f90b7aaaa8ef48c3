"""Result views: the limited list, display boxes, scroll targets, references and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import columns as C


def result_list(matches: DataFrame, most: int = CONFIG.result_list_max) -> DataFrame:
    """The first matches in document order, with the number of all."""
    first = matches.orderBy("page", "reading_ord").limit(most)
    return first.join(matches.agg(F.count(F.lit(1)).alias("n_all")))  # one row


def display_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Canvas boxes (rotated by ``rotation``) with padding, and the score's label."""
    x, y, w, h = C.rotate_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("rotation"))
    pad = F.greatest(F.lit(1.0), CONFIG.label_pad * h * height)
    return boxes.select("page", "ord", "rotation", (x * width - pad).alias("dx"), (y * height - pad).alias("dy"), (w * width + 2 * pad).alias("dw"), (h * height + 2 * pad).alias("dh"), F.format_number(F.col("score"), 2).alias("label"))


def scroll_targets(boxes: DataFrame, width: float, height: float, visible: float) -> DataFrame:
    """The point that comes to the top left of the window."""
    left = F.greatest(F.lit(0.0), (F.col("x") + F.col("w") / 2) * width - visible / 2)
    return boxes.select("page", "ord", left.alias("left"), F.greatest(F.lit(0.0), (F.col("y") - CONFIG.scroll_headroom) * height).alias("top"))


def reference_line(refs: DataFrame) -> DataFrame:
    """Per document: its references in page order, inexact ones marked."""
    one = F.concat(F.lit("p. "), F.col("label"), F.when(F.col("exact"), "").otherwise(" ≈"))
    rows = F.array_sort(F.collect_list(F.struct("page_number", "label", one.alias("s"))))
    return refs.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), " · ").alias("line"))


def lru(uses: DataFrame, keep: int = CONFIG.dt_cache_pages) -> DataFrame:
    """Per tab: the pages of its last uses."""
    last = uses.groupBy("tab", "page").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return last.withColumn("k", F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("last")))).where(F.col("k") <= keep).select("tab", "page", "k")


def drag_regions(drags: DataFrame, frames: DataFrame, least: float = CONFIG.snip_min_drag_px) -> DataFrame:
    """(page, ord, frame, x, y, w, h): dragged rectangles (page, ord, x, y, w, h, on a canvas) clipped to the frame (page, frame, fx, fy, fw, fh) that holds their centre, as shares of it, which ``store.cut_runs`` cuts. Drags that are shorter than ``least`` on a side have nulls; those off all frames have no row."""
    mid = lambda a, size: F.col(a) + F.col(size) / 2
    inside = lambda a, size, f, fs: (mid(a, size) >= F.col(f)) & (mid(a, size) < F.col(f) + F.col(fs))
    both = drags.join(frames, "page").where(inside("x", "w", "fx", "fw") & inside("y", "h", "fy", "fh"))
    left, top = F.greatest("x", "fx"), F.greatest("y", "fy")
    right, low = F.least(F.col("x") + F.col("w"), F.col("fx") + F.col("fw")), F.least(F.col("y") + F.col("h"), F.col("fy") + F.col("fh"))
    long_ = (F.col("w") >= least) & (F.col("h") >= least)
    shares = C.normalised(left - F.col("fx"), top - F.col("fy"), right - left, low - top, F.col("fw").cast("double"), F.col("fh").cast("double"))
    return both.select("page", "ord", "frame", *(F.when(long_, v).alias(c) for c, v in zip("xywh", shares)))
