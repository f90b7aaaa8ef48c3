"""Queries over rasters, templates, caches and viewer events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import columns as C
from ..functions import kernels as K
from ..operators import cache, display, raster, templates
from ..operators import search as S
from ..operators import textlayer as T
from ..sources.bridge import drawn, duck_pixels, glyph_raster, rasters, texts_of, view, view_of
from ..session import settings_of
from ..streaming import pages as P
from .registry import query
from .search import first_jump, look_up_index, search_document
from .text_queries import raw_items

col, lit = F.col, F.lit


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as cores: a table of one row group would keep all but one core idle while its pages are analysed. Larger tables stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def images(spark: SparkSession, d: str, table: str = "benchmark", glyphs: bool = False) -> DataFrame:
    texts = spark.read.parquet(f"{d}/{table}.parquet").select({"benchmark": "item_id", "documents": "doc_id"}[table], "text")
    return rasters(spread(texts), {"benchmark": "item_id", "documents": "doc_id"}[table], "text", glyphs)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, to be drawn by the kernel's worker."""
    return texts_of(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "doc_id", "text")


# binarisation (embedding values as grey pixels)

GREY = """gr AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i - 1 AS BIGINT) AS x, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS lum, CASE WHEN (i - 1) % 17 = 0 THEN i - 1 ELSE 255 END AS alpha FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
bn AS (SELECT vec_id, x, CASE WHEN alpha >= 16 AND 0.299::DOUBLE * lum + 0.587::DOUBLE * lum + 0.114::DOUBLE * lum < 160 THEN 1 ELSE 0 END AS ink FROM gr)"""


def binary(spark, d):
    g = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    lum = F.least(lit(255), F.greatest(lit(0), F.floor((col("v").cast("double") + 0.5) * 255)))
    alpha = F.when(col("x") % 17 == 0, col("x")).otherwise(255)
    return g.select("vec_id", col("x").cast("long").alias("x"), C.ink_of(lum, lum, lum, alpha).cast("long").alias("ink"))


@query("SELECT vec_id, x, CAST(ink AS BIGINT) AS ink FROM bn", ctes=GREY)
def b1_binarize(spark, d):
    return binary(spark, d)


@query("SELECT vec_id, CAST(sum(ink) AS BIGINT) AS ink FROM bn GROUP BY vec_id", ctes=GREY)
def f3_ink_count(spark, d):
    return binary(spark, d).groupBy("vec_id").agg(F.sum("ink").alias("ink"))


@query("SELECT vec_id, x, CAST(CASE WHEN ink = 1 THEN 0 ELSE 255 END AS BIGINT) AS grey FROM bn", ctes=GREY)
def s10_show_snip(spark, d):
    return binary(spark, d).select("vec_id", "x", F.when(col("ink") == 1, 0).otherwise(255).cast("long").alias("grey"))


@query("SELECT vec_id, CAST(floor(x / 8) AS BIGINT) AS byte, CAST(sum(CAST(ink AS BIGINT) << CAST(x % 8 AS INT)) AS BIGINT) AS packed, CAST(sum(ink) AS BIGINT) AS ink FROM bn GROUP BY vec_id, floor(x / 8)", ctes=GREY)
def j7_pack_bits(spark, d):
    """Eight pixels a byte, lowest bit first; unpacked again for the count."""
    packed = binary(spark, d).groupBy("vec_id", F.floor(col("x") / 8).alias("byte")).agg(F.sum(F.expr("shiftleft(ink, cast(x % 8 as int))")).alias("packed"))
    bits = F.aggregate(F.sequence(lit(0), lit(7)), lit(0).cast("long"), lambda n, k: n + F.getbit(col("packed"), k))
    return packed.withColumn("ink", bits)


# runs, components, clusters

PX_B = duck_pixels("benchmark", "item_id")
PX_D = duck_pixels("documents", "doc_id")
RUNS = """ink AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS isl FROM px WHERE ink = 1),
run AS (SELECT page, y, min(x) AS x0, max(x) AS x1, row_number() OVER (PARTITION BY page ORDER BY y, min(x)) AS id FROM ink GROUP BY page, y, isl)"""
COMPS = """RECURSIVE ed AS (SELECT a.page, a.id AS u, b.id AS v FROM run a JOIN run b ON a.page = b.page AND abs(a.y - b.y) <= 1 AND a.x1 >= b.x0 - CASE WHEN a.y = b.y THEN 0 ELSE 1 END AND a.x0 <= b.x1 + CASE WHEN a.y = b.y THEN 0 ELSE 1 END),
reach AS (SELECT page, id AS u, id AS v FROM run UNION SELECT r.page, r.u, ed.v FROM reach r JOIN ed ON ed.page = r.page AND ed.u = r.v),
rt AS (SELECT page, u AS id, min(v) AS root FROM reach GROUP BY page, u),
cc AS (SELECT r.page, root, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, CAST(sum(x1 - x0 + 1) AS BIGINT) AS ink FROM run r JOIN rt ON rt.page = r.page AND rt.id = r.id GROUP BY r.page, root)"""


@query("SELECT page, CAST(count(*) AS BIGINT) AS n, CAST(sum(x1 - x0 + 1) AS BIGINT) AS ink, CAST(sum((y * 3 + x0 * 5 + x1 * 7) % 1009) AS BIGINT) AS digest FROM run GROUP BY page", ctes=PX_D + ",\n" + RUNS)
def q3_label_runs(spark, d):
    """Runs of every document's whole raster, summed up by page."""
    r = raster.runs(documents(spark, d), drawn)
    return r.groupBy("page").agg(F.count(lit(1)).alias("n"), F.sum(col("x1") - col("x0") + 1).alias("ink"), F.sum((col("y") * 3 + col("x0") * 5 + col("x1") * 7) % 1009).alias("digest"))


@query("SELECT page, CAST(id - 1 AS BIGINT) AS n, y, x0, x1 FROM run", ctes=PX_B + ",\n" + RUNS)
def q1_compact_runs(spark, d):
    idx = raster.page_index(images(spark, d))
    rows = idx.select("page", F.posexplode("runs").alias("n", "r"), "row_start")
    y = F.size(F.filter("row_start", lambda s: s <= col("n"))) - 1
    return rows.select("page", col("n").cast("long").alias("n"), y.cast("long").alias("y"), col("r.x0").cast("long").alias("x0"), (col("r.x0") + col("r.len") - 1).cast("long").alias("x1"))


@query("SELECT page, y, x FROM px WHERE ink = 1", ctes=PX_B)
def q2_expand(spark, d):
    """Compact pages back to pixels."""
    back = raster.expand(raster.page_index(images(spark, d)))
    return raster.pixels(back, lambda m: m).select("page", "y", "x")


@query("SELECT page, CAST(id - 1 AS BIGINT) AS n, CAST((SELECT min(root) FROM rt WHERE rt.page = run.page AND rt.id = run.id) - 1 AS BIGINT) AS root FROM run", ctes=PX_B + ",\n" + RUNS + ",\n" + COMPS)
def e3_run_components(spark, d):
    return raster.run_components(images(spark, d)).select("page", "n", "root")


@query("SELECT page, x0, y0, x1, y1, ink FROM cc WHERE ink >= 4", ctes=PX_B + ",\n" + RUNS + ",\n" + COMPS)
def f1_component_bounds(spark, d):
    return raster.components(images(spark, d)).drop("n")


@query("SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY root) - 1 AS BIGINT) AS n, ink FROM cc", ctes=PX_B + ",\n" + RUNS + ",\n" + COMPS)
def g12_component_numbers(spark, d):
    return raster.components(images(spark, d), 1).select("page", "n", "ink")


@query("SELECT page, y, CAST(sum(c) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS BIGINT) AS start FROM (SELECT p.page, p.y, CAST(count(r.id) AS BIGINT) AS c FROM (SELECT DISTINCT page, y FROM px) p LEFT JOIN run r ON r.page = p.page AND r.y = p.y GROUP BY p.page, p.y)", ctes=PX_B + ",\n" + RUNS)
def g11_row_starts(spark, d):
    r = raster.runs(images(spark, d)).groupBy("page", "y").agg(F.count(lit(1)).alias("c"))
    rows = images(spark, d).select("page", F.explode(F.sequence(lit(0).cast("long"), col("h").cast("long") - 1)).alias("y")).join(r, ["page", "y"], "left").fillna(0, ["c"])
    before = F.sum("c").over(Window.partitionBy("page").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)) - col("c")
    return rows.select("page", "y", before.cast("long").alias("start"))


GROUPS = """big AS (SELECT * FROM cc WHERE ink >= 4),
ce AS (SELECT a.page, a.root AS u, b.root AS v FROM big a JOIN big b ON a.page = b.page AND a.x0 <= b.x1 + 2 AND b.x0 <= a.x1 + 2 AND a.y0 <= b.y1 + 2 AND b.y0 <= a.y1 + 2),
cr AS (SELECT page, u, v FROM ce UNION SELECT cr.page, cr.u, ce.v FROM cr JOIN ce ON ce.page = cr.page AND ce.u = cr.v),
cl AS (SELECT b.page, g.root, count(*) AS members, sum(ink) AS ink FROM big b JOIN (SELECT page, u, min(v) AS root FROM cr GROUP BY page, u) g ON g.page = b.page AND g.u = b.root GROUP BY b.page, g.root HAVING count(*) >= 2)"""
INDEX_SQL = """SELECT b.page, CAST((SELECT count(*) FROM run WHERE run.page = b.page) AS BIGINT) AS runs, CAST((SELECT count(*) FROM big WHERE big.page = b.page) AS BIGINT) AS comps, CAST((SELECT count(*) FROM cl WHERE cl.page = b.page) AS BIGINT) AS clusters, CAST(b.h AS BIGINT) AS h
FROM (SELECT page, max(y) + 1 AS h FROM px GROUP BY page) b"""


@query(INDEX_SQL, ctes=",\n".join([PX_B, RUNS, COMPS, GROUPS]))
def q4_analyze(spark, d):
    i = raster.page_index(images(spark, d))
    return i.select("page", *(F.size(c).cast("long").alias(c) for c in ("runs", "comps", "clusters")), col("h").cast("long").alias("h"))


@query(f"SELECT page, 4 * (h + 1) + 4 * runs + 20 * comps + 24 * clusters + 4 * comps AS bytes FROM ({INDEX_SQL})", ctes=",\n".join([PX_B, RUNS, COMPS, GROUPS]))
def q5_compact_bytes(spark, d):
    return raster.index_sizes(raster.page_index(images(spark, d)))


@query("SELECT page, comps AS n, comps > 40 AS skipped FROM (" + INDEX_SQL + ")", ctes=",\n".join([PX_B, RUNS, COMPS, GROUPS]))
def b27_dense_index_pages(spark, d):
    """Pages that are too dense to be searched, at a limit of 40 components."""
    i = raster.page_index(images(spark, d))
    kept = raster.admissible(i, 40).select("page", lit(False).alias("s"))
    return i.select("page", F.size("comps").cast("long").alias("n")).join(kept, "page", "left").select("page", "n", F.coalesce("s", lit(True)).alias("skipped"))


@query()
def a2_page_index(spark, d):
    """The page index of every document's whole raster."""
    i = raster.admissible(raster.page_index(documents(spark, d), pages=drawn))
    return i.select("page", "w", "h", F.size("runs").alias("n_runs"), F.size("comps").alias("n_comps"), F.size("clusters").alias("n_clusters"), "bytes")


# distance, crop, rotation, rescaling

DT = """inkp AS (SELECT page, y, x FROM px WHERE ink = 1),
bd AS (SELECT page, max(y) AS my FROM px GROUP BY page),
fullp AS (SELECT bd.page, yy.y, xx.x FROM bd CROSS JOIN LATERAL (SELECT unnest(range(0, my + 1)) AS y) yy CROSS JOIN (SELECT range AS x FROM range(64)) xx),
dt AS (SELECT p.page, p.y, p.x, CAST(least(21, coalesce(min(3 * greatest(abs(p.x - i.x), abs(p.y - i.y)) + least(abs(p.x - i.x), abs(p.y - i.y))), 21)) AS BIGINT) AS d FROM fullp p LEFT JOIN inkp i ON i.page = p.page AND i.y BETWEEN p.y - 6 AND p.y + 6 AND i.x BETWEEN p.x - 6 AND p.x + 6 GROUP BY p.page, p.y, p.x)"""


@query("SELECT page, y, x, d FROM dt", ctes=PX_B + ",\n" + DT)
def g8_chamfer_distance(spark, d):
    return raster.distances(images(spark, d)).select("page", "y", "x", "d")


CROP = "cb AS (SELECT page, min(x) AS ax, min(y) AS ay, max(x) AS bx, max(y) AS by FROM px WHERE ink = 1 GROUP BY page)"


@query("SELECT p.page, y - ay AS y, x - ax AS x FROM px p JOIN cb ON cb.page = p.page WHERE ink = 1", ctes=PX_B + ",\n" + CROP)
def f16_crop_to_ink(spark, d):
    return raster.pixels(images(spark, d), K.crop).select("page", "y", "x")


@query("SELECT p.page, 64 - 1 - x AS y, y AS x FROM px p WHERE ink = 1", ctes=PX_B)
def j6_rotate(spark, d):
    """One quarter turn: (x, y) goes to (y, w - 1 - x)."""
    return raster.pixels(images(spark, d), lambda m: np.rot90(m)).select("page", "y", "x")


@query("""SELECT page, ty AS y, tx AS x FROM (SELECT p.page, t.ty, t.tx, sum(p.ink) / CAST(max(area) AS DOUBLE) AS m FROM (SELECT f.page, f.y, f.x, coalesce(px.ink, 0) AS ink FROM fullp f LEFT JOIN px ON px.page = f.page AND px.y = f.y AND px.x = f.x) p
JOIN (SELECT bd.page, yy.ty, xx.tx, floor(yy.ty * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE)) AS ya, greatest(floor(yy.ty * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE)) + 1, ceil((yy.ty + 1) * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE))) AS yb,
  floor(xx.tx * 2.0) AS xa, greatest(floor(xx.tx * 2.0) + 1, ceil((xx.tx + 1) * 2.0)) AS xb, (least(my + 1, greatest(floor(yy.ty * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE)) + 1, ceil((yy.ty + 1) * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE)))) - floor(yy.ty * (my + 1) / CAST(floor((my + 1) * 0.5 + 0.5) AS DOUBLE))) * 2 AS area
  FROM bd CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(greatest(1, floor((my + 1) * 0.5 + 0.5)) AS BIGINT))) AS ty) yy CROSS JOIN (SELECT range AS tx FROM range(32)) xx) t ON t.page = p.page AND p.y >= ya AND p.y < yb AND p.x >= xa AND p.x < xb GROUP BY p.page, t.ty, t.tx) WHERE m >= 0.4""", ctes=PX_B + ",\n" + DT)
def j5_rescale_half(spark, d):
    half = lambda m: K.rescale(m, max(1, int(K.half_up(m.shape[1] * 0.5))), max(1, int(K.half_up(m.shape[0] * 0.5))))
    return raster.pixels(images(spark, d), half).select("page", "y", "x")


# pixel-level scores of a small template

SHAPE = np.array([[1, 0, 1, 0, 0], [0, 1, 0, 0, 1], [1, 1, 0, 1, 0], [0, 0, 1, 0, 1]], np.uint8)
INK = [(int(y), int(x)) for y, x in zip(*np.nonzero(SHAPE))]
TEMPLATE_CTES = (
    "tk AS (SELECT * FROM (VALUES " + ", ".join(f"({y}, {x})" for y, x in INK) + ") AS t(ty, tx)),\n"
    "wt AS (SELECT CAST(range AS BIGINT) AS d, CAST(CAST(greatest(0, 1 - range / 3.0::DOUBLE / 2) AS FLOAT) AS DOUBLE) AS weight FROM range(22)),\n"
    "pl AS (SELECT page, y AS oy, x AS ox FROM px WHERE ink = 1),\n"
    "fw AS (SELECT pl.page, oy, ox, sum(coalesce(weight, 0)) / count(*) AS forward FROM pl CROSS JOIN tk LEFT JOIN dt ON dt.page = pl.page AND dt.y = oy + ty AND dt.x = ox + tx LEFT JOIN wt ON wt.d = dt.d GROUP BY pl.page, oy, ox),\n"
    "tw AS (SELECT yy.range AS ty, xx.range AS tx, (SELECT weight FROM wt WHERE wt.d = least(21, (SELECT min(3 * greatest(abs(xx.range - tk.tx), abs(yy.range - tk.ty)) + least(abs(xx.range - tk.tx), abs(yy.range - tk.ty))) FROM tk))) AS weight FROM range(4) yy CROSS JOIN range(5) xx),\n"
    "rv AS (SELECT pl.page, oy, ox, sum(tw.weight) / count(*) AS reverse FROM pl CROSS JOIN tw JOIN inkp i ON i.page = pl.page AND i.y = oy + ty AND i.x = ox + tx GROUP BY pl.page, oy, ox)"
)
PIXEL_CTES = PX_B + ",\n" + DT + ",\n" + TEMPLATE_CTES


def scaled() -> K.Scaled:
    return K.Template(SHAPE, np.array([[0, 0, 4, 3, int(SHAPE.sum())]])).at(100)


def scores(spark, d):
    return templates.pixel_scores(images(spark, d), scaled())


@query("SELECT page, oy, ox, round(forward, 9) AS forward FROM fw", ctes=PIXEL_CTES)
def e4_template_ink_lookup(spark, d):
    return scores(spark, d).select("page", "oy", "ox", F.round("forward", 9).alias("forward"))


@query("SELECT pl.page, pl.oy, pl.ox, round(coalesce(reverse, 0), 9) AS reverse FROM pl LEFT JOIN rv ON rv.page = pl.page AND rv.oy = pl.oy AND rv.ox = pl.ox", ctes=PIXEL_CTES)
def e5_window_ink_range(spark, d):
    return scores(spark, d).select("page", "oy", "ox", F.round("reverse", 9).alias("reverse"))


@query("SELECT page, round(avg(forward), 9) AS forward FROM fw GROUP BY page", ctes=PIXEL_CTES)
def f4_forward_scores(spark, d):
    """The forward term of the score, averaged over a page's placements."""
    return scores(spark, d).groupBy("page").agg(F.round(F.avg("forward"), 9).alias("forward"))


@query("SELECT pl.page, round(avg(coalesce(reverse, 0)), 9) AS reverse FROM pl LEFT JOIN rv ON rv.page = pl.page AND rv.oy = pl.oy AND rv.ox = pl.ox GROUP BY pl.page", ctes=PIXEL_CTES)
def f5_reverse_scores(spark, d):
    """The reverse term, averaged over a page's placements."""
    return scores(spark, d).groupBy("page").agg(F.round(F.avg("reverse"), 9).alias("reverse"))


@query("SELECT page, oy, ox, round(score, 9) AS score FROM (SELECT fw.page, fw.oy, fw.ox, CASE WHEN forward + coalesce(reverse, 0) > 0 THEN 2 * forward * coalesce(reverse, 0) / (forward + coalesce(reverse, 0)) ELSE 0 END AS score, row_number() OVER (PARTITION BY fw.page ORDER BY round(CASE WHEN forward + coalesce(reverse, 0) > 0 THEN 2 * forward * coalesce(reverse, 0) / (forward + coalesce(reverse, 0)) ELSE 0 END, 9) DESC, fw.oy, fw.ox) AS k FROM fw LEFT JOIN rv ON rv.page = fw.page AND rv.oy = fw.oy AND rv.ox = fw.ox) WHERE k = 1", ctes=PIXEL_CTES)
def f6_best_pixel_placement(spark, d):
    both = scores(spark, d).withColumn("score", F.round(C.combine(col("forward"), col("reverse")), 9))
    return templates.best_of(both, ["oy", "ox"]).select("page", "oy", "ox", "score")


# search on glyph pages


def symbol(kind: int = 1) -> K.Template:
    """A template cut from a page of one glyph."""
    return S.template_from_region(glyph_raster(chr(96 + kind)), 0, 0, 20, 28)


@query("SELECT page, y - 1 AS y, x - 8 AS x FROM px WHERE ink = 1 AND y >= 1 AND x BETWEEN 8 AND 39", ctes=PX_B)
def a12_page_region(spark, d):
    """The part of each page's raster in columns 8 to 39 below the first row."""
    return raster.pixels(images(spark, d), lambda m: m[1:, 8:40] if m.shape[0] > 1 else None).select("page", "y", "x")


@query("SELECT page, CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS total FROM dt GROUP BY page", ctes=PX_B + ",\n" + DT)
def a14_expanded_pages(spark, d):
    """Pages ready for matching: expanded from the index, with their distance transform summed."""
    back = raster.expand(raster.page_index(images(spark, d)))
    return raster.distances(back).groupBy("page").agg(F.count(lit(1)).alias("n"), F.sum("d").alias("total"))


@query()
def r1_find_matches(spark, d):
    return S.find_matches(images(spark, d, glyphs=True), symbol(1))


@query()
def r2_page_matches(spark, d):
    return S.page_matches(images(spark, d, glyphs=True), symbol(1))


@query()
def r2_large_pages(spark, d):
    """The same on pages of 1836 x 2376 pixels with 1,400 glyphs, one for each item."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").repartition("item_id")
    return S.page_matches(rasters(items, "item_id", "text", large=True), symbol(1))


@query()
def e16_page_turns_search(spark, d):
    """Each page searched upright and in the turns that its text layer shows."""
    pages = spark.read.parquet(f"{d}/benchmark.parquet").select(col("item_id").alias("page"), col("item_id").cast("long").alias("doc_id"), lit(1).cast("long").alias("page_number"))
    turned = S.with_turns(images(spark, d, glyphs=True), pages, T.sideways_turns(raw_items(spark, d)))
    return S.page_matches(turned, symbol(4), threshold=0.9)


@query()
def e16_sideways_search(spark, d):
    """The template and its quarter turns on all pages, de-duplicated together."""
    return S.page_matches(images(spark, d, glyphs=True), symbol(4), turns=(0, 1, 2, 3), threshold=0.9)


@query()
def i2_union_turns(spark, d):
    raw = S.raw_matches(images(spark, d, glyphs=True), symbol(4), threshold=0.9, turns=(0, 2))
    return raw.groupBy("page").agg(F.count(lit(1)).alias("n"), F.max("score").alias("best"))


def glyph_docs(spark, d):
    """Benchmark items as documents of one page each, with an index page in the text layer of every fourth."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    pages = b.select(col("item_id").alias("page"), F.floor(col("item_id") / 4).cast("long").alias("doc_id"), (col("item_id") % 4 + 1).cast("long").alias("page_number"))
    docs = pages.groupBy("doc_id").agg(F.max("page_number").alias("total"))
    item = lambda o, s, x, y, w, h: F.struct(lit(o).cast("long").alias("item_ord"), s.alias("str"), lit(x).alias("x"), lit(y).alias("y"), lit(w).alias("w"), lit(h).alias("h"))
    head = F.when(col("page_number") == col("total"), "Index").otherwise("Text")
    texts = F.array(item(1, head, 0.1, 0.05, 0.2, 0.02), item(2, F.concat(lit("term, "), (col("doc_id") % 3 + 1).cast("string")), 0.99, 0.02, 0.005, 0.9), item(3, col("page_number").cast("string"), 0.5, 0.95, 0.02, 0.02))
    items = pages.join(docs, "doc_id").select("doc_id", "page_number", "total", F.explode(texts).alias("t")).select("doc_id", "page_number", "total", "t.*")
    outline = pages.select("doc_id", lit(1).cast("long").alias("ord"), lit(None).cast("string").alias("title"), "page_number", lit(1).cast("long").alias("total")).where("false")
    labels = pages.select("doc_id", "page_number", lit("").alias("label")).where("false")
    return images(spark, d, glyphs=True), pages, docs, outline, items, labels


@query()
def r4_look_up_index(spark, d):
    img, pages, docs, outline, items, labels = glyph_docs(spark, d)
    return look_up_index(img, pages, symbol(1), docs, outline, items, labels)[1]


@query()
def r6_search(spark, d):
    """Index lookup, then a search in the order that its references set."""
    img, pages, docs, outline, items, labels = glyph_docs(spark, d)
    _, refs, scanned = look_up_index(img, pages, symbol(1), docs, outline, items, labels)
    return search_document(img, pages, symbol(1), docs.select("doc_id", lit(1).cast("long").alias("start")), refs, scanned)


def turned_pages(pages: DataFrame) -> DataFrame:
    """What a text layer would show: every third page upside down, every fifth on its side."""
    turn = F.when(col("page") % 3 == 0, 2).when(col("page") % 5 == 0, 1)
    return pages.select("doc_id", "page_number", turn.cast("int").alias("turn")).where("turn is not null")


@query()
def r4_turned_look_up(spark, d):
    """Index lookup with pages searched in the turns of their text layer, too: the matches on index pages."""
    img, pages, docs, outline, items, labels = glyph_docs(spark, d)
    return look_up_index(img, pages, symbol(4), docs, outline, items, labels, turned=turned_pages(pages))[0]


@query()
def r6_turned_search(spark, d):
    """A search of whole documents, each page upright and in the turns of its text layer."""
    img, pages, docs, *_ = glyph_docs(spark, d)
    return search_document(img, pages, symbol(4), docs.select("doc_id", lit(1).cast("long").alias("start")), turned=turned_pages(pages))


@query()
def l9_first_jump(spark, d):
    img, pages, docs, *_ = glyph_docs(spark, d)
    return first_jump(search_document(img, pages, symbol(1), docs.select("doc_id", col("total").alias("start"))))


@query("SELECT CAST(item_id AS BIGINT) AS page, false AS dense, item_id % 5 = 0 AS failed FROM benchmark")
def l11_failure_isolation(spark, d):
    """The raster of every fifth page is cut off; the others are searched."""
    cut = F.when(col("page") % 5 == 0, F.expr("substring(bits, 1, length(bits) - 1)")).otherwise(col("bits"))
    return S.scan_report(images(spark, d).withColumn("bits", cut)).select("page", "dense", col("error").isNotNull().alias("failed"))


# cache and viewer state

CAP, RESERVED = 2500.0, (3, 4)
RANK = "rk AS (SELECT doc_id, page_number, bytes, total, CASE WHEN page_number IN (3, 4) THEN -1 WHEN page_number = 2 THEN 0 WHEN page_number < 2 THEN 2 * (2 - page_number) - 1 ELSE 2 * (page_number - 2) END AS rank FROM conv)"


def conv(spark, d):
    return view(spark, d, "conv")


def ranked(spark, d):
    return conv(spark, d).withColumn("rank", C.page_rank(col("page_number"), lit(2), col("page_number").isin(*RESERVED)).cast("long"))


@query("SELECT doc_id, page_number, CAST(rank AS BIGINT) AS rank FROM rk", "conv", RANK)
def g6_page_rank(spark, d):
    return ranked(spark, d).select("doc_id", "page_number", "rank")


@query("SELECT doc_id, page_number FROM conv WHERE page_number IN (3, 4)", "conv")
def e14_reserved_pages(spark, d):
    kept = spark.createDataFrame([(p,) for p in RESERVED], "page_number long")
    return conv(spark, d).join(kept, "page_number", "left_semi").select("doc_id", "page_number")


@query("SELECT doc_id, min_by(page_number, rank * 1000 + page_number) AS page_number FROM rk WHERE bytes % 4 <> 0 GROUP BY doc_id", "conv", RANK)
def e13_untried_page(spark, d):
    """The best-ranked page that was not tried, skipped or failed."""
    r = ranked(spark, d)
    tried = r.where("bytes % 4 = 0").select("doc_id", "page_number")
    return r.join(tried, ["doc_id", "page_number"], "left_anti").groupBy("doc_id").agg(F.min_by("page_number", F.struct("rank", "page_number")).alias("page_number"))


@query("SELECT doc_id, min_by(page_number, rank * 1000 + page_number) AS best FROM rk GROUP BY doc_id", "conv", RANK)
def h10_best_untried(spark, d):
    return ranked(spark, d).groupBy("doc_id").agg(F.min_by("page_number", F.struct("rank", "page_number")).alias("best"))


@query("SELECT doc_id, max_by(page_number, rank * 1000 - page_number) AS worst FROM rk WHERE rank > 0 GROUP BY doc_id", "conv", RANK)
def h9_evict_worst(spark, d):
    return ranked(spark, d).where("rank > 0").groupBy("doc_id").agg(F.max_by("page_number", F.struct("rank", -col("page_number"))).alias("worst"))


@query("SELECT doc_id, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (WHERE page_number IN (3, 4)), 0) AS BIGINT) AS reserved FROM conv GROUP BY doc_id", "conv")
def f12_cached_bytes(spark, d):
    return conv(spark, d).groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(col("page_number").isin(*RESERVED), col("bytes")).otherwise(0)).alias("reserved"))


@query("SELECT doc_id, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(2500 AS BIGINT) AS cap, sum(bytes) > 2500 AS \"full\" FROM conv GROUP BY doc_id", "conv")
def s9_memory(spark, d):
    return conv(spark, d).groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).select("doc_id", "bytes", lit(int(CAP)).cast("long").alias("cap"), (col("bytes") > CAP).alias("full"))


PRE = "pi AS (SELECT doc_id, page_number, bytes, CAST(sum(bytes) OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_number = 2 THEN 0 WHEN page_number < 2 THEN 2 * (2 - page_number) - 1 ELSE 2 * (page_number - 2) END ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conv)"


@query("SELECT doc_id, page_number, used FROM pi WHERE used <= 2500", "conv", PRE)
def a15_preindex(spark, d):
    return cache.preindex(conv(spark, d), CAP, 2).select("doc_id", "page_number", "used")


@query("SELECT c.doc_id, c.page_number FROM conv c LEFT JOIN (SELECT * FROM pi WHERE used <= 2500) p ON p.doc_id = c.doc_id AND p.page_number = c.page_number WHERE p.doc_id IS NULL", "conv", PRE)
def a13_missing_pages(spark, d):
    """Pages that are not in the index yet."""
    kept = cache.preindex(conv(spark, d), CAP, 2).select("doc_id", "page_number")
    return conv(spark, d).select("doc_id", "page_number").join(kept, ["doc_id", "page_number"], "left_anti")


@query("SELECT c.doc_id, CAST(count(p.doc_id) AS BIGINT) AS indexed, CAST(max(c.total) AS BIGINT) AS total, count(p.doc_id) < max(c.total) AS \"full\" FROM conv c LEFT JOIN (SELECT * FROM pi WHERE used <= 2500) p ON p.doc_id = c.doc_id AND p.page_number = c.page_number GROUP BY c.doc_id", "conv", PRE)
def s6_progress(spark, d):
    kept = cache.preindex(conv(spark, d), CAP, 2).select("doc_id", "page_number", lit(1).alias("k"))
    j = conv(spark, d).join(kept, ["doc_id", "page_number"], "left").groupBy("doc_id").agg(F.count("k").alias("indexed"), F.max("total").alias("total"))
    return j.withColumn("full", col("indexed") < col("total"))


def kept_sql(cap: float) -> str:
    return f"""r1 AS (SELECT *, list_position([{", ".join(map(str, RESERVED))}], page_number) AS place, CASE WHEN page_number = 2 THEN 0 WHEN page_number < 2 THEN 2 * (2 - page_number) - 1 ELSE 2 * (page_number - 2) END AS rank FROM conv),
r2 AS (SELECT *, coalesce(place, 0) > 0 AND sum(bytes) OVER (PARTITION BY doc_id ORDER BY coalesce(place, 0) = 0, place, page_number ROWS UNBOUNDED PRECEDING) <= {CONFIG.index_reserved_share} * {cap} AS reserved FROM r1),
r3 AS (SELECT *, sum(bytes) OVER (PARTITION BY doc_id ORDER BY CASE WHEN reserved THEN place - {len(RESERVED) + 1} ELSE rank END ROWS UNBOUNDED PRECEDING) <= {cap} AS kept FROM r2),
r4 AS (SELECT *, bool_or(NOT kept) OVER (PARTITION BY doc_id) AS "full" FROM r3)"""


KEPT = 'SELECT doc_id, page_number, bytes, reserved, "full" FROM r4 WHERE kept'


@query(KEPT, "conv", kept_sql(CAP))
def l5_admit(spark, d):
    return cache.retained(conv(spark, d), CAP, 2, RESERVED)


@query(KEPT, "conv", kept_sql(1200.0))
def l6_limits(spark, d):
    """The same under a smaller cap."""
    return cache.retained(conv(spark, d), 1200.0, 2, RESERVED)


EVENTS = "gen AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY tab ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM ev)"


@query("SELECT tab, event_id, CAST(generation AS BIGINT) AS generation FROM (SELECT *, max(generation) OVER (PARTITION BY tab) AS m FROM gen) WHERE generation = m", "ev", EVENTS)
def l3_generations(spark, d):
    return P.live_events(view(spark, d, "ev")).select("tab", "event_id", col("generation").cast("long").alias("generation"))


@query("SELECT DISTINCT tab, generation, page FROM (SELECT tab, CAST(generation AS BIGINT) AS generation, page FROM gen WHERE kind = 'view')", "ev", EVENTS)
def l4_one_build_per_page(spark, d):
    views = P.current_generation(view(spark, d, "ev")).where("kind = 'view'")
    return views.select("tab", col("generation").cast("long").alias("generation"), "page").dropDuplicates()


@query("SELECT tab, event_id, CAST(epoch_us(since) + 1800000000 AS BIGINT) AS released_at FROM (SELECT *, lag(ts) OVER (PARTITION BY tab ORDER BY ts, event_id) AS since FROM ev) WHERE ts > since + INTERVAL 30 MINUTE", "ev")
def l7_hidden_release(spark, d):
    return P.releases(view(spark, d, "ev")).select("tab", "event_id", F.unix_micros(col("released_at").cast("timestamp")).alias("released_at"))


@query("SELECT tab, page, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_id FROM ev WHERE kind IN ('view', 'click') GROUP BY tab, page", "ev")
def l1_incremental_results(spark, d):
    """Results page by page: the events drained as a stream in micro-batches, whose counts are merged by key."""
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")  # a pattern, as a stream takes no single file
    e = view_of(spark, "ev", events=stream).where(col("kind").isin("view", "click"))
    return P.merged_counts(e, ["tab", "page"], "event_id")


@query("SELECT tab, page, CAST(k AS BIGINT) AS k FROM (SELECT tab, page, row_number() OVER (PARTITION BY tab ORDER BY max(ts) DESC, max(event_id) DESC) AS k FROM ev GROUP BY tab, page) WHERE k <= 6", "ev")
def g9_recent_pages(spark, d):
    """The six pages of each tab that were used last."""
    return display.lru(view(spark, d, "ev")).select("tab", "page", col("k").cast("long").alias("k"))


SETTINGS_SQL = """SELECT event_id, CASE WHEN cap >= 50 THEN cap ELSE 250.0 END AS index_max_mb, CAST(CASE WHEN rel IN (5, 15, 30, 60) THEN rel ELSE 30 END AS BIGINT) AS release_after_min FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cap, event_id % 40 AS rel FROM events)"""


@query(SETTINGS_SQL)
def a17_read_settings(spark, d):
    """Settings from JSON, each field checked, with defaults for what is missing or invalid."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct(F.from_json("props", "k double")["k"].alias("index_max_mb"), (col("event_id") % 40).alias("release_after_min"))).alias("saved"))
    size, minutes = settings_of(col("saved"))
    return e.select("event_id", size, minutes.cast("long").alias("release_after_min"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def j9_json(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint").alias("s"))
    return e.select("event_id", F.from_json(F.to_json("s"), "k bigint")["k"].alias("k"))


def flagship(spark, sf_dir):
    return r2_page_matches(spark, sf_dir)
