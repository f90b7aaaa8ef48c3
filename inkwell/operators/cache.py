"""Which pages fit under a memory cap: running sums in rank order. Keeping them is left to Spark's storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.columns import page_rank


def preindex(pages: DataFrame, cap: float, anchor: int = 1) -> DataFrame:
    """Pages in rank order whose running bytes fit the cap: what background indexing keeps when pages come best first."""
    rank = page_rank(F.col("page_number"), F.lit(anchor), F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("rank", rank).withColumn("used", F.sum("bytes").over(w)).where(F.col("used") <= cap)


def retained(pages: DataFrame, cap: float, anchor: int = 1, reserved: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, page_number, bytes, reserved, full): the pages that fit the cap together, whatever the order they come in.

    Reserved pages go first, in their order, as far as their running bytes fit the reserved share;
    the others follow by rank. ``full`` says whether a page of the document stays out.
    """
    asked = pages.withColumn("place", F.array_position(F.array(*map(F.lit, reserved)).cast("array<long>"), F.col("page_number").cast("long")))
    each = Window.partitionBy("doc_id")
    first = each.orderBy(F.col("place") == 0, "place", "page_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.withColumn("reserved", (F.col("place") > 0) & (F.sum("bytes").over(first) <= CONFIG.index_reserved_share * cap))
    rank = F.when(F.col("reserved"), F.col("place") - F.lit(len(reserved) + 1)).otherwise(page_rank(F.col("page_number"), F.lit(anchor), F.lit(False)))
    used = F.sum("bytes").over(each.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("rank", rank).withColumn("kept", used <= cap)
    return rows.withColumn("full", F.max(~F.col("kept")).over(each)).where("kept").select("doc_id", "page_number", "bytes", "reserved", "full")
