"""Queries over the stored page index: searches, gates, many templates, regions, bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels as K
from ..operators import raster, store
from ..operators.shared import kept, scratch
from ..sources import page_source
from .raster_queries import COMPS, CROP, GROUPS, PX_B, RUNS, SHAPE, images, symbol
from .registry import query

col, lit = F.col, F.lit


def stored(spark: SparkSession, d: str, **options) -> DataFrame:
    return kept(store.stored_index(images(spark, d, **options)))


# clusters of a page with their bounds, of components of four pixels and more
BOUNDS = "clb AS (SELECT b.page, g.root, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(ink) AS BIGINT) AS ink FROM big b JOIN (SELECT page, u, min(v) AS root FROM cr GROUP BY page, u) g ON g.page = b.page AND g.u = b.root GROUP BY b.page, g.root HAVING count(*) >= 2)"
CANDIDATES = ",\n".join([PX_B, RUNS, COMPS, GROUPS, BOUNDS, "cand AS (SELECT page, x0, y0, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, ink FROM big UNION ALL SELECT page, x0, y0, x1 - x0 + 1, y1 - y0 + 1, ink FROM clb)"])


def gate_sql(th: str) -> str:
    return f"(c.h / ah BETWEEN 0.12 AND 1.6 AND c.w / aw BETWEEN 0.12 AND 1.6 AND abs((c.w / aw) / (c.h / ah) - 1) <= 0.28 AND abs(c.ink / (c.w * c.h) / ad - 1) <= 0.5 AND {th} * (c.h / ah) >= 6)"


#: A template for pages of text rasters: a stroke, and a dot apart from it.
MARK = K.prepare_template(np.concatenate([K.rescale(SHAPE, 10, 8), np.zeros((8, 4), np.uint8), np.pad(np.ones((4, 4), np.uint8), ((2, 2), (0, 0)))], 1))
MARK_SQL = "mark AS (SELECT * FROM (VALUES " + ", ".join(f"({w}, {h}, {d!r}::DOUBLE)" for w, h, d in store.anchor_rows(MARK)) + ") AS t(aw, ah, ad))"


@query(
    f"""SELECT p.page, CAST(coalesce(n, 0) * {len(MARK.anchors)} AS BIGINT) AS candidates, CAST(coalesce(gated, 0) AS BIGINT) AS gated FROM (SELECT DISTINCT page FROM px) p LEFT JOIN (SELECT page, count(*) AS n FROM cand GROUP BY page) a ON a.page = p.page
LEFT JOIN (SELECT c.page, count(*) AS gated FROM cand c JOIN mark ON {gate_sql(str(float(MARK.image.shape[0])))} GROUP BY c.page) g ON g.page = p.page""",
    ctes=CANDIDATES + ",\n" + MARK_SQL,
)
def r2_gate_counts(spark, d):
    """What the gate leaves of each stored page, by expressions over its boxes; pages without any are not expanded by a search."""
    return store.gate_counts(stored(spark, d), MARK)


@query()
def r2_stored_matches(spark, d):
    """The page search over a stored index: nothing is analysed again, and pages without a gated candidate are not expanded."""
    return store.stored_matches(stored(spark, d, glyphs=True), symbol(1))


# templates of whole pages: their anchors
TEMPLATES = """tce AS (SELECT a.page, a.root AS u, b.root AS v FROM cc a JOIN cc b ON a.page = b.page AND a.x0 <= b.x1 + 2 AND b.x0 <= a.x1 + 2 AND a.y0 <= b.y1 + 2 AND b.y0 <= a.y1 + 2),
tcr AS (SELECT page, u, v FROM tce UNION SELECT tcr.page, tcr.u, tce.v FROM tcr JOIN tce ON tce.page = tcr.page AND tce.u = tcr.v),
tcl AS (SELECT b.page, max(x1) - min(x0) + 1 AS w, max(y1) - min(y0) + 1 AS h, CAST(sum(ink) AS BIGINT) AS ink, min(x0 * 1000000 + b.root) AS place FROM cc b JOIN (SELECT page, u, min(v) AS root FROM tcr GROUP BY page, u) g ON g.page = b.page AND g.u = b.root GROUP BY b.page, g.root HAVING count(*) >= 2),
tc1 AS (SELECT page, w, h, ink FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ink DESC, place) AS k FROM tcl) WHERE k = 1),
tp AS (SELECT page, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, ink, row_number() OVER (PARTITION BY page ORDER BY ink DESC, root) AS k, max(ink) OVER (PARTITION BY page) AS m FROM cc),
ta AS (SELECT page, 0 AS anchor, w, h, ink FROM tc1 UNION ALL SELECT tp.page, CAST(k - 1 + CASE WHEN tc1.page IS NULL THEN 0 ELSE 1 END AS INT), tp.w, tp.h, tp.ink FROM tp LEFT JOIN tc1 ON tc1.page = tp.page WHERE (k = 1 OR tp.ink >= 0.35 * m) AND k + CASE WHEN tc1.page IS NULL THEN 0 ELSE 1 END <= 3)"""
TEMPLATE_CTES = ",\n".join([CANDIDATES, CROP, TEMPLATES])


def page_templates(spark: SparkSession, d: str) -> DataFrame:
    return store.template_table(images(spark, d))


@query('SELECT cb.page AS template_id, CAST(bx - ax + 1 AS BIGINT) AS w, CAST("by" - ay + 1 AS BIGINT) AS h, (SELECT CAST(count(*) AS BIGINT) FROM px WHERE px.page = cb.page AND px.ink = 1) AS ink, (SELECT CAST(count(*) AS BIGINT) FROM ta WHERE ta.page = cb.page) AS n_anchors FROM cb', ctes=TEMPLATE_CTES)
def a11_build_template(spark, d):
    """A template of each page's ink."""
    return page_templates(spark, d).select("template_id", *(col(c).cast("long").alias(c) for c in ("w", "h", "ink")), F.size("anchors").cast("long").alias("n_anchors"))


@query("SELECT page AS template_id, CAST(anchor AS BIGINT) AS anchor, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, ink FROM ta", ctes=TEMPLATE_CTES)
def q7_prepare_template(spark, d):
    """The anchors of each page's template: its largest cluster, its largest piece, and further large ones."""
    a = page_templates(spark, d).select("template_id", F.posexplode("anchors").alias("anchor", "a"))
    side = lambda p: (col(f"a.{p}1") - col(f"a.{p}0") + 1).cast("long")
    return a.select("template_id", col("anchor").cast("long").alias("anchor"), side("x").alias("w"), side("y").alias("h"), col("a.ink").cast("long").alias("ink"))


@query(
    """SELECT page AS template_id, CAST(tw AS BIGINT) AS w, CAST(th AS BIGINT) AS h, CAST(count(*) FILTER (WHERE m >= 0.4) AS BIGINT) AS ink FROM (SELECT t.page, tw, th, ty, tx, count(i.page) / CAST(max((yb - ya) * (xb - xa)) AS DOUBLE) AS m FROM (
SELECT page, ax, ay, tw, th, ty, tx, floor(ty * fh / th) AS ya, least(fh, greatest(floor(ty * fh / th) + 1, ceil((ty + 1) * (fh / th)))) AS yb, floor(tx * fw / tw) AS xa, least(fw, greatest(floor(tx * fw / tw) + 1, ceil((tx + 1) * (fw / tw)))) AS xb
FROM (SELECT *, CAST(bx - ax + 1 AS DOUBLE) AS fw, CAST("by" - ay + 1 AS DOUBLE) AS fh, CAST(greatest(1, floor((bx - ax + 1) * 0.5 + 0.5)) AS DOUBLE) AS tw, CAST(greatest(1, floor(("by" - ay + 1) * 0.5 + 0.5)) AS DOUBLE) AS th FROM cb) s
CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(th AS BIGINT))) AS ty) yy CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(tw AS BIGINT))) AS tx) xx) t
LEFT JOIN (SELECT page, y, x FROM px WHERE ink = 1) i ON i.page = t.page AND i.y - ay >= ya AND i.y - ay < yb AND i.x - ax >= xa AND i.x - ax < xb GROUP BY t.page, tw, th, ty, tx) GROUP BY page, tw, th""",
    ctes=PX_B + ",\n" + CROP,
)
def q6_scaled_templates(spark, d):
    """Each page's template at half its size."""
    return store.scaled_templates(page_templates(spark, d), [50]).select("template_id", *(col(c).cast("long").alias(c) for c in ("w", "h", "ink")))


@query(
    f"""SELECT t.page AS template_id, CAST(t.anchor AS BIGINT) AS anchor, c.page, CAST(count(*) AS BIGINT) AS n, CAST(sum((c.x0 * 3 + c.y0 * 5 + c.w * 7 + c.h * 11) % 1009) AS BIGINT) AS digest
FROM (SELECT ta.*, w AS aw, h AS ah, CAST(ink AS DOUBLE) / (w * h) AS ad, CAST("by" - ay + 1 AS DOUBLE) AS th FROM ta JOIN cb ON cb.page = ta.page) t JOIN cand c ON {gate_sql('th')} GROUP BY t.page, t.anchor, c.page""",
    ctes=TEMPLATE_CTES,
)
def e1_many_templates(spark, d):
    """The candidates on all pages for the templates of all pages, by one join over cells."""
    found = store.candidate_rows(stored(spark, d))
    pairs = store.gated_candidates(found, page_templates(spark, d)).join(found, ["page", "cand"])
    digest = (col("x0") * 3 + col("y0") * 5 + col("w") * 7 + col("h") * 11) % 1009
    return pairs.groupBy("template_id", col("anchor").cast("long").alias("anchor"), "page").agg(F.count(lit(1)).alias("n"), F.sum(digest).cast("long").alias("digest"))


# bytes and regions

LENGTH = lambda v: f"(1 + CASE WHEN {v} >= 128 THEN 1 ELSE 0 END + CASE WHEN {v} >= 16384 THEN 1 ELSE 0 END)"


@query(
    f"""SELECT r.page, CAST(sum({LENGTH('n')}) + coalesce(any_value(b), 0) AS BIGINT) AS bytes FROM (SELECT p.page, p.y, count(run.id) AS n FROM (SELECT DISTINCT page, y FROM px) p LEFT JOIN run ON run.page = p.page AND run.y = p.y GROUP BY p.page, p.y) r
LEFT JOIN (SELECT page, sum({LENGTH('gap')} + {LENGTH('(x1 - x0)')}) AS b FROM (SELECT page, x0, x1, x0 - coalesce(lag(x1) OVER (PARTITION BY page, y ORDER BY x0), 0) AS gap FROM run) GROUP BY page) u ON u.page = r.page GROUP BY r.page""",
    ctes=PX_B + ",\n" + RUNS,
)
def q1_stored_run_bytes(spark, d):
    """The bytes that a page's runs take in the stored index, by their column."""
    return stored(spark, d).select("page", F.octet_length("runs").cast("long").alias("bytes"))


@query("SELECT page, CAST(id - 1 AS BIGINT) AS n, y, x0, x1 FROM run", ctes=PX_B + ",\n" + RUNS)
def q2_stored_runs(spark, d):
    """Runs read back from the stored bytes."""
    rows = store.run_rows(stored(spark, d))
    return rows.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("y", "x0")) - 1).cast("long").alias("n"), "y", "x0", "x1")


#: Three regions of each page, from its id; the second is off small pages, and a limit of pixels makes some too large.
REGION_SQL = """rg AS (SELECT page, region, CAST(page % 7 AS DOUBLE) / 10 + CASE WHEN region = 2 AND page % 5 = 0 THEN 1.5 ELSE 0.0 END - 0.1 AS x, CAST(page % 3 AS DOUBLE) / 4 - 0.1 AS y, 0.2 + CAST(region AS DOUBLE) / 5 AS w, 0.3 + CAST(region AS DOUBLE) / 4 AS h
FROM (SELECT CAST(item_id AS BIGINT) AS page FROM benchmark) CROSS JOIN (SELECT unnest([1, 2, 3]) AS region)),
sz AS (SELECT page, CAST(max(y) + 1 AS BIGINT) AS hh FROM px GROUP BY page),
ct AS (SELECT rg.page, region, CAST(greatest(0, floor(x * 64)) AS BIGINT) AS x0, CAST(greatest(0, floor(y * hh)) AS BIGINT) AS y0, CAST(least(64, ceil((x + w) * 64)) AS BIGINT) AS x1, CAST(least(hh, ceil((y + h) * hh)) AS BIGINT) AS y1 FROM rg JOIN sz ON sz.page = rg.page),
ce2 AS (SELECT *, greatest(0, x1 - x0) * 2 AS w, greatest(0, y1 - y0) * 2 AS h FROM ct),
er AS (SELECT *, CASE WHEN w = 0 OR h = 0 THEN 'off the page' WHEN w * h > 1200 THEN 'too large' END AS error FROM ce2)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(col("item_id").cast("long").alias("page"), F.explode(F.array(lit(1), lit(2), lit(3))).alias("region"))
    off = F.when((col("region") == 2) & (col("page") % 5 == 0), 1.5).otherwise(0.0)
    return b.select("page", "region", ((col("page") % 7) / 10 + off - 0.1).alias("x"), ((col("page") % 3) / 4 - 0.1).alias("y"), (0.2 + col("region") / 5).alias("w"), (0.3 + col("region") / 4).alias("h"))


def cuts(spark: SparkSession, d: str) -> DataFrame:
    return store.cut_runs(raster.page_index(images(spark, d)), regions(spark, d), cfg=Config(max_snip_pixels=1200.0))


@query("SELECT e.page, CAST(region AS BIGINT) AS region, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, error, CAST(CASE WHEN error IS NULL THEN (SELECT count(*) FROM px WHERE px.page = e.page AND ink = 1 AND px.x >= e.x0 AND px.x < e.x1 AND px.y >= e.y0 AND px.y < e.y1) END AS BIGINT) AS ink FROM er e", ctes=PX_B + ",\n" + REGION_SQL)
def a3_cut_regions(spark, d):
    """Size at twice the scale, error, and ink of three regions of each page."""
    ink = F.aggregate("runs", lit(0).cast("long"), lambda n, r: n + r["x1"] - r["x0"] + 1)
    return cuts(spark, d).select("page", col("region").cast("long").alias("region"), col("w").cast("long").alias("w"), col("h").cast("long").alias("h"), "error", ink.alias("ink"))


@query("SELECT e.page, CAST(region AS BIGINT) AS region, px.y - e.y0 AS y, px.x - e.x0 AS x FROM er e JOIN px ON px.page = e.page AND ink = 1 AND px.x >= e.x0 AND px.x < e.x1 AND px.y >= e.y0 AND px.y < e.y1 WHERE error IS NULL", ctes=PX_B + ",\n" + REGION_SQL)
def a12_region_pixels(spark, d):
    """The pixels of the cuts, before they are enlarged."""
    rows = cuts(spark, d).where("error is null").select("page", col("region").cast("long").alias("region"), F.explode("runs").alias("r"))
    return rows.select("page", "region", col("r.y").cast("long").alias("y"), F.explode(F.sequence(col("r.x0").cast("long"), col("r.x1").cast("long"))).alias("x"))


SOURCE_SQL = """SELECT 'all' AS part, page, comps, clusters, h FROM (SELECT b.page, CAST((SELECT count(*) FROM big WHERE big.page = b.page) AS BIGINT) AS comps, CAST((SELECT count(*) FROM cl WHERE cl.page = b.page) AS BIGINT) AS clusters, CAST(b.h AS BIGINT) AS h FROM (SELECT page, max(y) + 1 AS h FROM px GROUP BY page) b)"""


@query(
    "SELECT * FROM every UNION ALL SELECT 'some', page, comps, clusters, h FROM every WHERE page > 9 AND page <= 21 UNION ALL SELECT 'listed', page, comps, clusters, h FROM every WHERE page IN (3, 12, 30)",
    ctes=",\n".join([PX_B, RUNS, COMPS, GROUPS, f"every AS ({SOURCE_SQL})"]),
)
def a2_page_source(spark, d):
    """The stored index through its data source: whole, by a range of pages, and by a list."""
    path = scratch(spark)
    page_source.write_pages(store.stored_index(images(spark, d)), path, 8)
    every = page_source.read_pages(spark, path)
    some = page_source.read_pages(spark, path, first=10, last=21)
    listed = page_source.read_pages(spark, path, pages=[3, 12, 30])
    row = lambda df, part: df.select(lit(part).alias("part"), "page", F.size("comps").cast("long").alias("comps"), F.size("clusters").cast("long").alias("clusters"), col("h").cast("long").alias("h"))
    return row(every, "all").unionAll(row(some, "some")).unionAll(row(listed, "listed"))
