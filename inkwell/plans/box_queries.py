"""Queries over boxes: projections, gates, windows, joins and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import columns as C
from ..operators import boxes as B
from ..operators import display
from ..sources.bridge import view
from .registry import query

col, lit = F.col, F.lit
#: (anchor, aw, ah, adensity) of a template of three pieces.
ANCHORS = [(0, 14, 12, 0.08), (1, 9, 11, 0.05), (2, 20, 16, 0.03)]
TEMPLATE_H = 18.0
ANCHOR_SQL = "anchor AS (SELECT * FROM (VALUES (0, 14, 12, 0.08), (1, 9, 11, 0.05), (2, 20, 16, 0.03)) AS t(anchor, aw, ah, adensity))"
GATE_SQL = """(h / ah BETWEEN 0.12 AND 1.6 AND w / aw BETWEEN 0.12 AND 1.6 AND abs((w / aw) / (h / ah) - 1) <= 0.28
  AND abs(ink / (w * h) / CAST(adensity AS DOUBLE) - 1) <= 0.5 AND 18.0 * (h / ah) >= 6)"""
IOU_CTES = """pair AS (SELECT a.page, a.ord AS oa, b.ord AS ob, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter,
  a.w * a.h + b.w * b.h AS areas FROM box a JOIN box b ON a.page = b.page AND a.ord < b.ord)"""


def before_page(rows: DataFrame) -> DataFrame:
    """(page, before): rows on earlier pages. Ranges of pages are summed first, so that the one ordered pass sees a row for each range only."""
    per = rows.groupBy("page").agg(F.count(lit(1)).alias("c")).withColumn("range", F.floor(col("page") / 4096))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.groupBy("range").agg(F.sum("c").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(upto), lit(0))).drop("all")
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("range").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    return per.withColumn("inside", inside).join(ranges, "range").select("page", (col("base") + col("inside")).alias("before"))


def box(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "box")


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "anchor int, aw int, ah int, adensity double")


@query("SELECT page, ord, x1 - x + 1 AS w, y1 - y + 1 AS h, (x + x1) / 2.0 AS cx, (y + y1) / 2.0 AS cy FROM box", "box")
def b2_finalize_box(spark, d):
    return box(spark, d).select("page", "ord", C.box_size(col("x"), col("x1")).alias("w"), C.box_size(col("y"), col("y1")).alias("h"), C.box_centre(col("x"), col("x1")).alias("cx"), C.box_centre(col("y"), col("y1")).alias("cy"))


@query("SELECT page, ord, round(ink / (w * h), 9) AS density FROM box", "box")
def b3_density(spark, d):
    return box(spark, d).select("page", "ord", F.round(C.density(col("ink"), col("w"), col("h")), 9).alias("density"))


@query("SELECT page, ord, i AS s, CAST(floor(100 * (s0 * f) + 0.5) AS BIGINT) AS k FROM (SELECT page, ord, (h / 12.0 + w / 10.0) / 2 AS s0 FROM box) CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 1 - 0.035::DOUBLE), (2, 1 + 0.035::DOUBLE)) AS t(i, f)", "box")
def b4_scale_keys(spark, d):
    s0 = (col("h") / 12.0 + col("w") / 10.0) / 2
    return box(spark, d).select("page", "ord", F.posexplode(C.refined_scales(s0)).alias("s", "v")).select("page", "ord", "s", C.scale_key(col("v")).cast("long").alias("k"))


@query("SELECT page, ord, floor(x * s) AS a, ceil((x1 + 1) * s) - 1 AS b, (floor(x * s) + ceil((x1 + 1) * s) - 1) / 2.0 AS c FROM (SELECT *, CAST(50 + ink AS DOUBLE) / 100 AS s FROM box)", "box")
def b5_anchor_boxes(spark, d):
    s = (50 + col("ink")).cast("double") / 100
    a, b, c = C.scaled_anchor(col("x"), col("x1"), s)
    return box(spark, d).select("page", "ord", a.cast("double").alias("a"), b.cast("double").alias("b"), c.alias("c"))


WEIGHT_SQL = """SELECT h, v, round(CAST(CAST(greatest(0.0, 1 - d / cap) AS FLOAT) AS DOUBLE), 6) AS linear, CASE WHEN d <= cap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step,
  round(CAST(CAST(CASE WHEN d < cap THEN (1 - d / cap) * (1 - d / cap) ELSE 0 END AS FLOAT) AS DOUBLE), 6) AS quadratic, round(CAST(CAST(CASE WHEN d < cap THEN 1 - (d / cap) * (d / cap) ELSE 0 END AS FLOAT) AS DOUBLE), 6) AS smooth
FROM (SELECT DISTINCT CAST(h * 4 AS BIGINT) AS h FROM box) CROSS JOIN LATERAL (SELECT greatest(2.0::DOUBLE, h * 0.1::DOUBLE) AS cap) CROSS JOIN (SELECT CAST(range AS BIGINT) AS v, range / 3.0::DOUBLE AS d FROM range(22))"""


@query(WEIGHT_SQL, "box")
def b6_weight_table(spark, d):
    rows = box(spark, d).select((col("h") * 4).alias("h")).distinct().withColumn("v", F.explode(F.sequence(lit(0).cast("long"), lit(21).cast("long"))))
    return rows.select("h", "v", *(F.round(C.weight(col("v"), col("h"), s).cast("double"), 6).alias(s) for s in ("linear", "step", "quadratic", "smooth")))


@query("SELECT page, ord, round(CASE WHEN f + r > 0 THEN 2 * f * r / (f + r) ELSE 0 END, 9) AS harmonic, round(least(f, r), 9) AS smallest, round(sqrt(f * r), 9) AS geometric FROM (SELECT page, ord, score AS f, CAST(ink - 1 AS DOUBLE) / 16 AS r FROM box)", "box")
def b7_combine(spark, d):
    f, r = col("score"), (col("ink") - 1).cast("double") / 16
    return box(spark, d).select("page", "ord", F.round(C.combine(f, r), 9).alias("harmonic"), F.round(C.combine(f, r, "min"), 9).alias("smallest"), F.round(C.combine(f, r, "geometric"), 9).alias("geometric"))


@query("SELECT page, oa, ob, round(CASE WHEN inter = 0 THEN 0.0 ELSE inter / (areas - inter) END, 9) AS iou FROM pair", "box", IOU_CTES)
def b8_box_iou(spark, d):
    a, b = box(spark, d).alias("a"), box(spark, d).alias("b")
    both = a.join(b, (col("a.page") == col("b.page")) & (col("a.ord") < col("b.ord")))
    iou = C.box_iou(*(col(f"{t}.{c}") for t in "ab" for c in "xywh"))
    return both.select(col("a.page").alias("page"), col("a.ord").alias("oa"), col("b.ord").alias("ob"), F.round(iou, 9).alias("iou"))


@query("SELECT page, ord, x / 1836.0::DOUBLE AS x_norm, y / 2376.0::DOUBLE AS y_norm, w / 1836.0::DOUBLE AS w_norm, h / 2376.0::DOUBLE AS h_norm FROM box", "box")
def b9_normalise(spark, d):
    return box(spark, d).select("page", "ord", *(v.alias(f"{c}_norm") for c, v in zip("xywh", C.normalised(*map(col, "xywh"), 1836.0, 2376.0))))


NORM = "nb AS (SELECT page, ord, x / 128.0::DOUBLE AS x, y / 128.0::DOUBLE AS y, w / 128.0::DOUBLE AS w, h / 128.0::DOUBLE AS h, score, CAST(ord % 4 * 90 AS BIGINT) AS rotation FROM box)"


def norm_box(spark, d):
    return box(spark, d).select("page", "ord", *((col(c) / 128.0).alias(c) for c in "xywh"), "score", (col("ord") % 4 * 90).alias("rotation"))


ROTATED = """rb AS (SELECT page, ord, rotation, score, CASE rotation WHEN 90 THEN 1 - y - h WHEN 180 THEN 1 - x - w WHEN 270 THEN y ELSE x END AS rx, CASE rotation WHEN 90 THEN x WHEN 180 THEN 1 - y - h WHEN 270 THEN 1 - x - w ELSE y END AS ry,
  CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS rw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS rh FROM nb)"""


@query("SELECT page, ord, rotation, rx, ry, rw, rh FROM rb", "box", NORM + "," + ROTATED)
def b10_rotate_box(spark, d):
    r = C.rotate_box(col("x"), col("y"), col("w"), col("h"), col("rotation"))
    return norm_box(spark, d).select("page", "ord", "rotation", *(c.alias(n) for c, n in zip(r, ("rx", "ry", "rw", "rh"))))


@query(f"SELECT page, ord, CAST(anchor AS BIGINT) AS anchor FROM box JOIN anchor ON {GATE_SQL}", "box", ANCHOR_SQL)
def b13_geometric_gate(spark, d):
    return B.gated(box(spark, d), anchors(spark), TEMPLATE_H).select("page", "ord", col("anchor").cast("long").alias("anchor"))


@query(f"SELECT page, ord, CAST(anchor AS BIGINT) AS anchor, floor(x + w / 2.0 - aw / 2.0 + 0.5) AS ox FROM box JOIN anchor ON {GATE_SQL}", "box", ANCHOR_SQL)
def e1_anchor_candidates(spark, d):
    ox = C.half_up(col("x") + col("w") / 2.0 - col("aw") / 2.0).cast("double")
    return B.gated(box(spark, d), anchors(spark), TEMPLATE_H).select("page", "ord", col("anchor").cast("long").alias("anchor"), ox.alias("ox"))


@query(f"SELECT page, CAST(count(*) * 27 AS BIGINT) AS n, round(sum((h / ah + w / aw) / 2) * 27, 6) AS total, CAST(0 AS BIGINT) AS shift FROM box JOIN anchor ON {GATE_SQL} GROUP BY page", "box", ANCHOR_SQL)
def e15_placements(spark, d):
    p = B.placements(B.gated(box(spark, d), anchors(spark), TEMPLATE_H))
    return p.groupBy("page").agg(F.count(lit(1)).alias("n"), F.round(F.sum("scale"), 6).alias("total"), F.sum(col("dx") + col("dy")).cast("long").alias("shift"))


@query("SELECT page, ord, ink FROM box WHERE ink >= 4", "box")
def b14_noise_filter(spark, d):
    return box(spark, d).where(col("ink") >= CONFIG.min_cc_pixels).select("page", "ord", "ink")


@query("SELECT page, CAST(count(*) AS BIGINT) AS members, CAST(sum(ink) AS BIGINT) AS ink FROM box GROUP BY page HAVING count(*) >= 2", "box")
def b15_cluster_filter(spark, d):
    return box(spark, d).groupBy("page").agg(F.count(lit(1)).alias("members"), F.sum("ink").alias("ink")).where("members >= 2")


@query("SELECT page, ord, score FROM box WHERE score >= 0.5", "box")
def b16_score_threshold(spark, d):
    from ..operators.search import shown

    return shown(box(spark, d), CONFIG.search_floor).select("page", "ord", "score")


@query("SELECT page, ord, score, CAST(row_number() OVER (ORDER BY page, ord) AS BIGINT) AS shown FROM box WHERE score >= 0.9", "box")
def b17_display_filter(spark, d):
    from ..operators.search import shown

    kept = shown(box(spark, d)).select("page", "ord", "score")
    inside = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
    return kept.join(before_page(kept), "page").select("page", "ord", "score", (col("before") + inside).cast("long").alias("shown"))


SCRIPT_CTES = """wc AS (SELECT a.page, a.ord, b.ord AS comp, a.x AS ox, a.y AS oy, a.w, a.h, b.x AS x0, b.y AS y0, b.x1, b.y1, b.w AS cw, b.h AS ch, a.x + a.w AS rgt, a.y + a.h - 1 AS bot FROM box a JOIN box b ON a.page = b.page AND a.ord <> b.ord),
k AS (SELECT *, (x0 >= rgt - 1 AND x0 <= rgt + 0.4::DOUBLE * h AND ch >= 0.25::DOUBLE * h AND ch <= 1.15::DOUBLE * h) AS near, (y0 <= bot - 0.1::DOUBLE * h AND y1 >= bot + 0.2::DOUBLE * h) AS sub, (y1 >= oy + 0.1::DOUBLE * h AND y0 <= oy - 0.2::DOUBLE * h) AS sup,
 (x0 < rgt AND x1 >= ox AND x0 >= ox - 1.5::DOUBLE * w AND ch <= 0.4::DOUBLE * h AND cw <= 1.5::DOUBLE * w AND least(x1, rgt - 1) - greatest(x0, ox) + 1 >= 0.5::DOUBLE * cw AND NOT (ch <= 3 AND cw >= 0.7::DOUBLE * w)
  AND ((y1 < oy AND oy - y1 - 1 <= 0.25::DOUBLE * h) OR (y0 > bot AND y0 - bot - 1 <= 0.25::DOUBLE * h))) AS accent FROM wc)"""


@query("SELECT page, ord, comp, CASE WHEN sub AND sup THEN 'both' WHEN sub THEN 'sub' ELSE 'super' END AS kind FROM k WHERE near AND (sub OR sup)", "box", SCRIPT_CTES)
def b18_scripts(spark, d):
    b = box(spark, d)
    return B.attached_pairs(b, b).where(col("script").isNotNull()).select("page", "ord", "comp", col("script").alias("kind"))


@query("SELECT page, ord, comp FROM k WHERE accent", "box", SCRIPT_CTES)
def b19_accents(spark, d):
    b = box(spark, d)
    return B.attached_pairs(b, b).where("accent").select("page", "ord", "comp")


@query("SELECT page, ord, CAST(count(*) AS BIGINT) AS n, CAST(sum(comp) AS BIGINT) AS comps FROM k WHERE accent OR (near AND (sub OR sup)) GROUP BY page, ord", "box", SCRIPT_CTES)
def e6_attached_ink(spark, d):
    b = box(spark, d)
    return B.attached_pairs(b, b).groupBy("page", "ord").agg(F.count(lit(1)).alias("n"), F.sum("comp").alias("comps"))


PUNCT_CTES = """rw AS (SELECT CAST(l_orderkey AS BIGINT) AS comp, 3 + l_orderkey % 4 AS w, 7 AS h, l_linenumber - 1 AS y, CAST(min(1 + l_partkey % (3 + l_orderkey % 4)) AS BIGINT) AS span, CAST(min(1 + l_partkey % (3 + l_orderkey % 4)) AS BIGINT) AS ink FROM lineitem GROUP BY ALL),
sh AS (SELECT comp, w, h, coalesce(max(span) FILTER (WHERE y < 2), 0) AS head_max, coalesce(max(span) FILTER (WHERE y >= 2), 0) AS rest_max, coalesce(max(span) FILTER (WHERE y >= 4), 0) AS tail_max,
  coalesce(sum(ink) FILTER (WHERE y < 2), 0) AS head_ink, coalesce(sum(span) FILTER (WHERE y < 2), 0) AS head_span FROM rw GROUP BY comp, w, h)"""


def shape_rows(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    w = 3 + col("l_orderkey") % 4
    span = 1 + col("l_partkey") % w
    return li.groupBy(col("l_orderkey").alias("comp"), w.alias("w"), lit(7).alias("h"), (col("l_linenumber") - 1).alias("y")).agg(F.min(span).alias("span")).withColumn("ink", col("span"))


@query("SELECT comp, head_max, rest_max, tail_max, CAST(head_ink AS BIGINT) AS head_ink, CAST(head_span AS BIGINT) AS head_span FROM sh", ctes=PUNCT_CTES)
def f15_punctuation_maxima(spark, d):
    return B.punctuation_shapes(shape_rows(spark, d)).select("comp", "head_max", "rest_max", "tail_max", col("head_ink").cast("long").alias("head_ink"), col("head_span").cast("long").alias("head_span"))


@query("SELECT comp FROM sh WHERE w <= 0.55 * h AND head_max >= rest_max AND head_max >= 0.75 * w AND head_ink >= 0.85 * head_span AND tail_max <= 0.67 * w", ctes=PUNCT_CTES)
def b20_punctuation_shape(spark, d):
    return B.punctuation_shapes(shape_rows(spark, d)).where("comma").select("comp")


@query("SELECT page, CAST(count(*) AS BIGINT) AS n, count(*) > 6 AS skipped FROM box GROUP BY page", "box")
def b27_dense_pages(spark, d):
    return box(spark, d).groupBy("page").agg(F.count(lit(1)).alias("n")).withColumn("skipped", col("n") > 6)


@query("SELECT page, ord, w * 180 * (h * 160) AS px, w * 180 * (h * 160) > 8e6 AS too_large FROM box", "box")
def b28_snip_guard(spark, d):
    px = col("w") * 180 * (col("h") * 160)
    return box(spark, d).select("page", "ord", px.alias("px"), (px > CONFIG.max_snip_pixels).alias("too_large"))


@query("SELECT page, ord, CASE WHEN x >= 4 AND y >= 4 AND x + w <= 90 AND y + h <= 60 THEN CAST(ink AS DOUBLE) ELSE 0 END AS weight FROM box", "box")
def b33_off_page(spark, d):
    inside = (col("x") >= 4) & (col("y") >= 4) & (col("x") + col("w") <= 90) & (col("y") + col("h") <= 60)
    return box(spark, d).select("page", "ord", F.when(inside, col("ink").cast("double")).otherwise(0.0).alias("weight"))


CLUSTER_CTES = """RECURSIVE e AS (SELECT a.page, a.ord AS u, b.ord AS v FROM box a JOIN box b ON a.page = b.page AND a.x <= b.x1 + 2 AND b.x <= a.x1 + 2 AND a.y <= b.y1 + 2 AND b.y <= a.y1 + 2),
r AS (SELECT page, u, v FROM e UNION SELECT r.page, r.u, e.v FROM r JOIN e ON e.page = r.page AND e.u = r.v),
g AS (SELECT page, u AS ord, min(v) AS root FROM r GROUP BY page, u),
c AS (SELECT b.page, root, min(x) AS x0, min(y) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(ink) AS BIGINT) AS ink, CAST(count(*) AS BIGINT) AS members FROM box b JOIN g ON g.page = b.page AND g.ord = b.ord GROUP BY b.page, root HAVING count(*) >= 2)"""


@query("SELECT page, x0, y0, x1, y1, ink, members FROM c", "box", CLUSTER_CTES)
def e2_cluster_components(spark, d):
    return B.proximity_clusters(box(spark, d))


@query("SELECT page, CAST(count(*) AS BIGINT) AS n, CAST(max(members) AS BIGINT) AS largest, CAST(sum(ink) AS BIGINT) AS ink, min(x0) AS x0, max(y1) AS y1 FROM c GROUP BY page", "box", CLUSTER_CTES)
def f2_cluster_bounds(spark, d):
    c = B.proximity_clusters(box(spark, d))
    return c.groupBy("page").agg(F.count(lit(1)).alias("n"), F.max("members").alias("largest"), F.sum("ink").alias("ink"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


DEDUPE_CTES = """o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS k FROM box),
f AS (SELECT page, CAST(1 AS BIGINT) AS k, [{'x': x, 'y': y, 'w': w, 'h': h, 'ord': ord, 'score': score}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT /*r*/ o.page, o.k, CASE WHEN len(list_filter(f.kept, lambda q: (CASE WHEN greatest(0, least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x)) * greatest(0, least(q.y + q.h, o.y + o.h) - greatest(q.y, o.y)) = 0 THEN 0 ELSE
    greatest(0, least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x)) * greatest(0, least(q.y + q.h, o.y + o.h) - greatest(q.y, o.y)) / (q.w * q.h + o.w * o.h - greatest(0, least(q.x + q.w, o.x + o.w) - greatest(q.x, o.x)) * greatest(0, least(q.y + q.h, o.y + o.h) - greatest(q.y, o.y))) END) > 0.5)) > 0
    THEN f.kept ELSE list_append(f.kept, {'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'ord': o.ord, 'score': o.score}) END FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1),
z AS (SELECT page, unnest(kept) AS m, generate_subscripts(kept, 1) - 1 AS rank FROM (SELECT page, arg_max(kept, k) AS kept FROM f GROUP BY page))"""


@query("SELECT page, CAST(rank AS BIGINT) AS rank, m.ord AS ord, m.score AS score FROM z", "box", DEDUPE_CTES)
def e7_dedupe(spark, d):
    return B.dedupe(box(spark, d)).select("page", col("rank").cast("long").alias("rank"), "ord", "score")


@query("SELECT page, ord, score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS BIGINT) AS k FROM box", "box")
def h3_score_sort(spark, d):
    return box(spark, d).select("page", "ord", "score", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "ord")).cast("long").alias("k"))


READING_CTES = """o AS (SELECT *, y + h / 2.0 AS cy, row_number() OVER (PARTITION BY page ORDER BY y + h / 2.0, ord) AS k FROM box),
f AS (SELECT page, k, ord, x, cy AS lcy, CAST(h AS DOUBLE) AS lh, CAST(1 AS BIGINT) AS line FROM o WHERE k = 1
  UNION ALL SELECT /*r*/ o.page, o.k, o.ord, o.x, CASE WHEN abs(o.cy - f.lcy) <= 0.5 * least(o.h, f.lh) THEN f.lcy ELSE o.cy END, CASE WHEN abs(o.cy - f.lcy) <= 0.5 * least(o.h, f.lh) THEN greatest(f.lh, o.h) ELSE o.h END,
    CASE WHEN abs(o.cy - f.lcy) <= 0.5 * least(o.h, f.lh) THEN f.line ELSE f.line + 1 END FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1)"""


@query("SELECT page, ord, line, CAST(row_number() OVER (PARTITION BY page ORDER BY line, x, k) AS BIGINT) AS reading_ord FROM f", "box", READING_CTES)
def g1_reading_order(spark, d):
    return B.reading_order(box(spark, d)).select("page", "ord", col("line").cast("long").alias("line"), col("reading_ord").cast("long").alias("reading_ord"))


@query("SELECT page, ord, line, CAST(row_number() OVER (ORDER BY page, line, x, k) AS BIGINT) AS n FROM f", "box", READING_CTES)
def h4_document_order(spark, d):
    order = B.reading_order(box(spark, d))
    return order.join(before_page(order), "page").select("page", "ord", col("line").cast("long").alias("line"), (col("before") + col("reading_ord")).cast("long").alias("n"))


@query("SELECT page, CAST(count(*) AS BIGINT) AS clusters, CAST(max(members) AS BIGINT) AS most FROM c GROUP BY page", "box", CLUSTER_CTES)
def b15_cluster_members(spark, d):
    """Groups of two boxes and more, which alone are clusters."""
    return B.proximity_clusters(box(spark, d)).groupBy("page").agg(F.count(lit(1)).alias("clusters"), F.max("members").alias("most"))


@query("SELECT page, ord, ink, CAST(row_number() OVER (PARTITION BY page ORDER BY x, ord) AS BIGINT) AS k FROM box", "box")
def h2_by_left_edge(spark, d):
    return box(spark, d).select("page", "ord", "ink", F.row_number().over(Window.partitionBy("page").orderBy("x", "ord")).cast("long").alias("k"))


@query("SELECT page, ord, k FROM (SELECT page, ord, ink, row_number() OVER (PARTITION BY page ORDER BY ink DESC, ord) AS k, max(ink) OVER (PARTITION BY page) AS m FROM box) WHERE k <= 3 AND (k = 1 OR ink >= 0.35 * m)", "box")
def h1_anchor_top_k(spark, d):
    return B.anchor_pieces(box(spark, d)).select("page", "ord", col("k").cast("long").alias("k"))


@query("""SELECT page, kind, ord, ink FROM (SELECT page, 'piece' AS kind, ord, ink FROM (SELECT page, ord, ink, row_number() OVER (PARTITION BY page ORDER BY ink DESC, ord) AS k, max(ink) OVER (PARTITION BY page) AS m FROM box) WHERE k <= 2 AND (k = 1 OR ink >= 0.35 * m)
UNION ALL SELECT page, 'cluster', CAST(0 AS BIGINT), max(ink) FROM c GROUP BY page)""", "box", CLUSTER_CTES)
def f17_anchor_list(spark, d):
    b = box(spark, d)
    largest = B.proximity_clusters(b).groupBy("page").agg(F.max("ink").alias("ink")).select("page", lit("cluster").alias("kind"), lit(0).cast("long").alias("ord"), "ink")
    return B.anchor_pieces(b).where("k <= 2").select("page", lit("piece").alias("kind"), "ord", "ink").unionByName(largest)


@query("SELECT page, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE score >= 0.9) AS BIGINT) AS shown, CAST(sum(ink) AS BIGINT) AS ink FROM box GROUP BY page", "box")
def f11_counts(spark, d):
    from ..operators.search import page_counts

    b = box(spark, d)
    return page_counts(b).join(b.groupBy("page").agg(F.sum("ink").alias("ink")), "page")


@query("SELECT DISTINCT page FROM box WHERE score >= 0.9", "box")
def f10_distinct_pages(spark, d):
    return box(spark, d).where("score >= 0.9").select("page").distinct()


@query(f"SELECT CAST((SELECT count(*) FROM box) * 3 AS BIGINT) AS candidates, CAST(count(*) AS BIGINT) AS gated, CAST(count(*) * 27 AS BIGINT) AS scored FROM box JOIN anchor ON {GATE_SQL}", "box", ANCHOR_SQL)
def f13_match_statistics(spark, d):
    b = box(spark, d)
    g = B.gated(b, anchors(spark), TEMPLATE_H).agg(F.count(lit(1)).alias("gated"), (F.count(lit(1)) * 27).alias("scored"))
    return b.agg((F.count(lit(1)) * 3).alias("candidates")).join(g)  # one row each


@query("SELECT page, round(sum(score * ink) / sum(ink), 9) AS forward FROM box GROUP BY page", "box")
def f4_forward_mean(spark, d):
    return box(spark, d).groupBy("page").agg(F.round(F.sum(col("score") * col("ink")) / F.sum("ink"), 9).alias("forward"))


@query("SELECT page, CASE WHEN count(*) FILTER (WHERE x < 60) = 0 THEN 0 ELSE round(sum(CASE WHEN x < 60 THEN score ELSE 0 END) / count(*) FILTER (WHERE x < 60), 9) END AS reverse FROM box GROUP BY page", "box")
def f5_reverse_mean(spark, d):
    inside = col("x") < 60
    return box(spark, d).groupBy("page").agg(F.when(F.count_if(inside) == 0, 0.0).otherwise(F.round(F.sum(F.when(inside, col("score")).otherwise(0.0)) / F.count_if(inside), 9)).alias("reverse"))


@query("SELECT page, ord AS best, score FROM (SELECT page, ord, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS k FROM box) WHERE k = 1", "box")
def f6_best_placement(spark, d):
    return box(spark, d).groupBy("page").agg(F.min_by("ord", F.struct((-col("score")).alias("s"), "ord")).alias("best"), F.max("score").alias("score"))


@query("SELECT page, list_sort(list(ink))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM box GROUP BY page", "box")
def f9_upper_median(spark, d):
    return box(spark, d).groupBy("page").agg(C.upper_median(F.collect_list(col("ink").cast("double"))).cast("long").alias("median"))


@query("SELECT page, CAST(4 * (max(y1) + 2) + 4 * sum(h) + 20 * count(*) + 24 * count(*) FILTER (WHERE ink > 8) + 4 * count(*) AS BIGINT) AS bytes FROM box GROUP BY page", "box")
def f18_compact_bytes(spark, d):
    return box(spark, d).groupBy("page").agg(C.compact_bytes(F.max("y1") + 1, F.sum("h"), F.count(lit(1)), F.count_if(col("ink") > 8), lit(97)).cast("long").alias("bytes"))


@query("SELECT page, ord, kind FROM (SELECT page, ord, 'component' AS kind FROM box WHERE ink >= 4 UNION ALL SELECT page, CAST(1000 + row_number() OVER (PARTITION BY page ORDER BY y0, x0, ink, members, x1, y1) AS BIGINT), 'cluster' FROM c)", "box", CLUSTER_CTES)
def i1_candidates(spark, d):
    b = box(spark, d)
    n = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "ink", "members", "x1", "y1"))
    groups = B.proximity_clusters(b).select("page", (1000 + n).cast("long").alias("ord"), lit("cluster").alias("kind"))
    return b.where(col("ink") >= 4).select("page", "ord", lit("component").alias("kind")).unionByName(groups)


@query("""SELECT page, ord, CAST(sum(ink) AS BIGINT) AS ink, CAST(count(*) AS BIGINT) AS n FROM (SELECT page, ord, ink FROM box UNION ALL SELECT k.page, k.ord, b.ink FROM k JOIN box b ON b.page = k.page AND b.ord = k.comp WHERE accent OR (near AND (sub OR sup))) GROUP BY page, ord""", "box", SCRIPT_CTES)
def i8_window_and_attached(spark, d):
    b = box(spark, d)
    near = B.attached_pairs(b, b, also=("ink",)).select("page", "ord", "ink")
    return b.select("page", "ord", "ink").unionAll(near).groupBy("page", "ord").agg(F.sum("ink").alias("ink"), F.count(lit(1)).alias("n"))


@query("SELECT page, ord, score, CAST((SELECT count(*) FROM box) AS BIGINT) AS n_all FROM (SELECT page, ord, score FROM box ORDER BY page, ord LIMIT 300)", "box")
def s1_result_list(spark, d):
    """The list shows 300 results by definition."""
    return display.result_list(box(spark, d).withColumn("reading_ord", col("ord"))).select("page", "ord", "score", "n_all")


@query("SELECT page, ord, n_more FROM (SELECT page, ord, CAST((SELECT count(*) FROM box) - 300 AS BIGINT) AS n_more FROM box ORDER BY page, ord LIMIT 300)", "box")
def h5_list_limit(spark, d):
    listed = display.result_list(box(spark, d).withColumn("reading_ord", col("ord")))
    return listed.select("page", "ord", (col("n_all") - CONFIG.result_list_max).alias("n_more"))


@query("""SELECT page, ord, rotation, rx * 800 - pad AS dx, ry * 600 - pad AS dy, rw * 800 + 2 * pad AS dw, rh * 600 + 2 * pad AS dh, printf('%.2f', score) AS label FROM (SELECT *, greatest(1.0, 0.08::DOUBLE * rh * 600) AS pad FROM rb)""", "box", NORM + "," + ROTATED)
def s3_display_boxes(spark, d):
    return display.display_boxes(norm_box(spark, d), 800.0, 600.0)


@query("SELECT page, ord, greatest(0, (x + w / 2) * 800 - 150) AS \"left\", greatest(0, (y - 0.12::DOUBLE) * 600) AS top FROM nb", "box", NORM)
def s4_scroll_target(spark, d):
    return display.scroll_targets(norm_box(spark, d), 800.0, 600.0, 300.0)


@query("SELECT CAST(count(*) FILTER (WHERE score >= 0.9) AS BIGINT) AS n_shown, CAST(count(DISTINCT page) FILTER (WHERE score >= 0.9) AS BIGINT) AS n_pages, CAST(count(*) FILTER (WHERE score < 0.9) AS BIGINT) AS n_weaker, CAST((SELECT count(*) FROM (SELECT page FROM box GROUP BY page HAVING count(*) > 6)) AS BIGINT) AS n_dense, CAST(0 AS BIGINT) AS n_failed FROM box", "box")
def s7_summary(spark, d):
    from ..operators.search import summary

    b = box(spark, d)
    report = b.groupBy("page").agg((F.count(lit(1)) > 6).alias("dense")).withColumn("error", lit(None).cast("string"))
    return summary(b, report)


@query("SELECT page, ord, CAST((ord - 1 + CASE WHEN ord % 2 = 0 THEN 1 ELSE -1 END + n) % n AS BIGINT) AS next FROM (SELECT page, ord, count(*) OVER (PARTITION BY page) AS n FROM box)", "box")
def g7_step(spark, d):
    b = box(spark, d).withColumn("n", F.count(lit(1)).over(Window.partitionBy("page")))
    return b.select("page", "ord", C.stepped(col("ord") - 1, F.when(col("ord") % 2 == 0, 1).otherwise(-1), col("n")).alias("next"))


@query("SELECT page, ord, CAST(greatest(0, floor(x / 97.0 * 500)) AS BIGINT) AS px0, CAST(greatest(0, floor(y / 80.0 * 400)) AS BIGINT) AS py0, CAST(least(500, ceil((x + w) / 97.0 * 500)) - greatest(0, floor(x / 97.0 * 500)) AS BIGINT) AS pw, CAST(least(400, ceil((y + h) / 80.0 * 400)) - greatest(0, floor(y / 80.0 * 400)) AS BIGINT) AS ph FROM box WHERE least(500, ceil((x + w) / 97.0 * 500)) > floor(x / 97.0 * 500) AND least(400, ceil((y + h) / 80.0 * 400)) > floor(y / 80.0 * 400)", "box")
def a3_render_region(spark, d):
    """Pixel bounds of normalised rectangles on a 500 x 400 raster; empty ones give no row."""
    x0, y0 = F.greatest(lit(0), F.floor(col("x") / 97.0 * 500)), F.greatest(lit(0), F.floor(col("y") / 80.0 * 400))
    w, h = F.least(lit(500), F.ceil((col("x") + col("w")) / 97.0 * 500)) - x0, F.least(lit(400), F.ceil((col("y") + col("h")) / 80.0 * 400)) - y0
    return box(spark, d).select("page", "ord", x0.alias("px0"), y0.alias("py0"), w.alias("pw"), h.alias("ph")).where("pw > 0 and ph > 0")


SCALE_CTES = """p AS (SELECT page, ord, CAST(w * 90 AS DOUBLE) AS pw, CAST(h * 110 AS DOUBLE) AS ph FROM box),
s AS (SELECT page, ord, pw, ph, CAST(3 * sqrt(40e6 / (ceil(pw * 3) * ceil(ph * 3))) AS DOUBLE) AS s, 0 AS n FROM p WHERE ceil(pw * 3) * ceil(ph * 3) > 40e6
  UNION ALL SELECT /*r*/ page, ord, pw, ph, s * 0.99::DOUBLE, n + 1 FROM s WHERE ceil(pw * s) * ceil(ph * s) > 40e6)"""


@query("SELECT page, ord, round(3.0::DOUBLE, 9) AS scale FROM p WHERE ceil(pw * 3) * ceil(ph * 3) <= 40e6 UNION ALL SELECT page, ord, round(arg_max(s, n), 9) FROM s GROUP BY page, ord", "box", SCALE_CTES)
def a7_index_scale(spark, d):
    return box(spark, d).select("page", "ord", F.round(C.index_scale((col("w") * 90).cast("double"), (col("h") * 110).cast("double")), 9).alias("scale"))


DRAGS = """fr AS (SELECT DISTINCT page, frame, 2 + (frame - 1) * 48 AS fx, 3 AS fy, 44 AS fw, 60 AS fh FROM box CROSS JOIN (SELECT unnest([1, 2]) AS frame)),
dg AS (SELECT b.page, ord, frame, fx, fy, fw, fh, greatest(x, fx) AS l, greatest(y, fy) AS t, least(x + w, fx + fw) AS r, least(y + h, fy + fh) AS b, w >= 4 AND h >= 4 AS long_ FROM box b JOIN fr ON fr.page = b.page AND x + w / 2.0 >= fx AND x + w / 2.0 < fx + fw AND y + h / 2.0 >= fy AND y + h / 2.0 < fy + fh)"""


@query("SELECT page, ord, frame, CASE WHEN w >= 6 AND h >= 6 THEN (l - fx) / CAST(fw AS DOUBLE) END AS x, CASE WHEN w >= 6 AND h >= 6 THEN (t - fy) / CAST(fh AS DOUBLE) END AS y, CASE WHEN w >= 6 AND h >= 6 THEN (r - l) / CAST(fw AS DOUBLE) END AS w, CASE WHEN w >= 6 AND h >= 6 THEN (b - t) / CAST(fh AS DOUBLE) END AS h FROM (SELECT dg.*, box.w, box.h FROM dg JOIN box ON box.page = dg.page AND box.ord = dg.ord)", "box", DRAGS)
def a10_drag_regions(spark, d):
    """Dragged rectangles as regions of the page, of two side by side, that holds their centre; drags below six pixels give no region."""
    b = box(spark, d)
    frames = b.select("page").distinct().select("page", F.explode(F.array(lit(1), lit(2))).alias("frame")).select("page", "frame", (2 + (col("frame") - 1) * 48).alias("fx"), lit(3).alias("fy"), lit(44).alias("fw"), lit(60).alias("fh"))
    return display.drag_regions(b.select("page", "ord", "x", "y", "w", "h"), frames, 6.0)


@query("""SELECT page, ord, CASE WHEN r - l < 4 OR b - t < 4 THEN NULL ELSE greatest(l, 10) END AS x0, CASE WHEN r - l < 4 OR b - t < 4 THEN NULL ELSE least(r, 100) END AS x1 FROM (SELECT page, ord, x AS l, x + w - 3 AS r, y AS t, y + h - 3 AS b FROM box) WHERE (l + r) / 2.0 BETWEEN 10 AND 100""", "box")
def a10_snip_rect(spark, d):
    """Dragged rectangles clipped to the page (columns 10 to 100) that holds their centre; short drags give null."""
    left, right, short = col("x"), col("x") + col("w") - 3, (col("w") - 3 < CONFIG.snip_min_drag_px) | (col("h") - 3 < CONFIG.snip_min_drag_px)
    clip = lambda c: F.when(~short, c)
    return box(spark, d).where(((left + right) / 2.0).between(10, 100)).select("page", "ord", clip(F.greatest(left, lit(10))).alias("x0"), clip(F.least(right, lit(100))).alias("x1"))
