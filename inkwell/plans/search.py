"""End-to-end searches: a page search, and an index lookup that orders it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import kernels as K
from ..operators import bookindex as I
from ..operators import search as S


def look_up_index(images: DataFrame, pages: DataFrame, template: K.Template, docs: DataFrame, outline: DataFrame, items: DataFrame, labels: DataFrame, min_score: float = CONFIG.similarity_threshold, turned: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches on index pages, references, index pages). ``pages`` maps a raster's page to (doc_id, page_number).

    References come from hits of at least ``min_score``, each label once, in page order. Pages are searched
    in the turns of ``turned`` (doc_id, page_number, turn), too. The three results are computed where they are
    used; a caller that uses them often may persist them.
    """
    if turned is not None:
        images = S.with_turns(images, pages, turned)
    index = I.index_pages(docs, outline, items)
    mine = pages.join(index, ["doc_id", "page_number"])
    found = S.page_matches(images.join(mine.select("page"), "page", "left_semi"), template).join(mine.select("page", "doc_id", "page_number"), "page")
    hits = found.where(F.col("score") >= min_score).select("doc_id", "page_number", F.col("reading_ord").cast("long").alias("hit"), *(F.col(f"{c}_norm").alias(c) for c in "xywh"))
    refs = I.page_refs(hits, items).select("doc_id", "label").distinct()
    return found, I.resolve_labels(refs, docs, labels, items), index.select("doc_id", "page_number")


def search_document(images: DataFrame, pages: DataFrame, template: K.Template, starts: DataFrame, refs: DataFrame | None = None, scanned: DataFrame | None = None, turned: DataFrame | None = None) -> DataFrame:
    """Rows of MATCH with the page's place in the scan order; index pages that a lookup has searched are not searched again. Pages are searched upright and in the turns of ``turned``."""
    if turned is not None:
        images = S.with_turns(images, pages, turned)
    first = None
    if refs is not None:
        ranked = refs.select("doc_id", "page_number", F.struct("page_number", "label").alias("pos"))
        first = ranked.groupBy("doc_id", "page_number").agg(F.min("pos").alias("p")).select("doc_id", "page_number", F.col("p.page_number").cast("long").alias("pos"))
        jump = first.groupBy("doc_id").agg(F.min("pos").alias("jump"))
        starts = starts.join(jump, "doc_id", "left").select("doc_id", F.coalesce("jump", "start").alias("start"))
    order = I.scan_order(pages, starts, first)
    if scanned is not None:
        order = order.join(scanned, ["doc_id", "page_number"], "left_anti")
    todo = pages.join(order, ["doc_id", "page_number"])
    found = S.page_matches(images.join(todo.select("page"), "page", "left_semi"), template)
    return found.join(todo.select("page", "doc_id", "page_number", F.col("ord").alias("scan_ord")), "page")


def first_jump(matches: DataFrame, min_score: float = CONFIG.similarity_threshold) -> DataFrame:
    """The match that a search makes current: the first shown one in scan order."""
    w = F.struct("scan_ord", "reading_ord")
    return S.shown(matches, min_score).groupBy("doc_id").agg(F.min_by(F.struct("page_number", "reading_ord", "score"), w).alias("m")).select("doc_id", "m.*")
