"""Queries over text layers, outlines, labels and page orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG, INDEX_TITLE, NOTATION_TITLE
from ..functions import columns as C
from ..operators import bookindex as I
from ..operators import display
from ..operators import textlayer as T
from ..operators.shared import kept
from ..sources.bridge import view
from .registry import query

col, lit = F.col, F.lit
# DuckDB has no lookahead: 'index' not before a word that begins with 'theor' is written as two tests.
AHEAD = r"(?!\s+theor)"
TITLE = INDEX_TITLE.replace(AHEAD, "")
THEORY = INDEX_TITLE[: INDEX_TITLE.index(r"index\b" + AHEAD)] + r"index\s+theor)"


def title_sql(c: str) -> str:
    return f"(regexp_matches({c}, '{TITLE}') AND NOT (regexp_matches({c}, '{THEORY}')))"


def head_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '^(?:\\d+|[ivxlc]+)\\s+', '', 'i'), '\\s+(?:\\d+|[ivxlc]+)$', '', 'i')"
    return f"(length({bare}) <= 40 AND regexp_matches({bare}, '{NOTATION_TITLE}'))"


RAW_CTES = """raw AS (SELECT doc_id, page_number, item_ord, str, CASE turn WHEN 0 THEN 10.0 WHEN 1 THEN -skew WHEN 2 THEN -10.0 ELSE skew END AS a, CASE turn WHEN 0 THEN skew WHEN 1 THEN 10.0 WHEN 2 THEN -skew ELSE -10.0 END AS b,
  x * 500 AS e, y * 700 AS f, turn, 8 + 100 * h AS size, 300 * w AS width FROM item),
rt AS (SELECT *, -b / 10 * size / 10 * 10 AS c, a / 10 * size / 10 * 10 AS d, CAST(((floor(atan2(b, a) / (pi() / 2) + 0.5) % 4) + 4) % 4 AS BIGINT) AS q FROM raw)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "item")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pg").select("doc_id", "total").distinct()


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with text matrices: four directions, a little skewed."""
    pick = lambda *v: F.element_at(F.array(*v), (col("turn") + 1).cast("int"))
    ten = lit(10.0)
    i = items(spark, d).withColumns({"a": pick(ten, -col("skew"), -ten, col("skew")), "b": pick(col("skew"), ten, -col("skew"), -ten), "size": 8 + 100 * col("h"), "width": 300 * col("w")})
    i = i.withColumns({"c": -col("b") / 10 * col("size") / 10 * 10, "d": col("a") / 10 * col("size") / 10 * 10})
    return i.withColumn("transform", F.array("a", "b", "c", "d", col("x") * 500, col("y") * 700)).withColumn("height", lit(0.0))


@query("SELECT doc_id, page_number, item_ord, q AS turn FROM rt", "item", RAW_CTES)
def b11_quarter_turns(spark, d):
    return raw_items(spark, d).select("doc_id", "page_number", "item_ord", C.quarter_turns(col("a"), col("b")).cast("long").alias("turn"))


BOX_SQL = """bx AS (SELECT *, sqrt(c * c + d * d) AS up, sqrt(a * a + b * b) AS along FROM rt),
pt AS (SELECT *, c / up * up AS vx, d / up * up AS vy, a / along AS ux, b / along AS uy FROM bx),
tb AS (SELECT doc_id, page_number, item_ord, str, q,
  least(e + 0.8 * vx, e - 0.2 * vx, e + ux * width + 0.8 * vx, e + ux * width - 0.2 * vx) AS x0, greatest(e + 0.8 * vx, e - 0.2 * vx, e + ux * width + 0.8 * vx, e + ux * width - 0.2 * vx) AS x1,
  least(800 - (f + 0.8 * vy), 800 - (f - 0.2 * vy), 800 - (f + uy * width + 0.8 * vy), 800 - (f + uy * width - 0.2 * vy)) AS y0, greatest(800 - (f + 0.8 * vy), 800 - (f - 0.2 * vy), 800 - (f + uy * width + 0.8 * vy), 800 - (f + uy * width - 0.2 * vy)) AS y1 FROM pt)"""
ROUND_BOX = "round(x0 / 600, 6) AS x, round(y0 / 800, 6) AS y, round((x1 - x0) / 600, 6) AS w, round((y1 - y0) / 800, 6) AS h"


@query(f"SELECT doc_id, page_number, item_ord, {ROUND_BOX} FROM tb", "item", RAW_CTES + ",\n" + BOX_SQL)
def b12_text_boxes(spark, d):
    box = C.text_box(col("transform"), col("width"), col("height"), 600.0, 800.0)
    return raw_items(spark, d).select("doc_id", "page_number", "item_ord", *(F.round(b, 6).alias(n) for b, n in zip(box, "xywh")))


@query(f"SELECT doc_id, page_number, item_ord, str, {ROUND_BOX} FROM tb WHERE q = 0 AND trim(str) <> ''", "item", RAW_CTES + ",\n" + BOX_SQL)
def a4_page_text(spark, d):
    return T.upright_items(raw_items(spark, d), 600.0, 800.0).select("doc_id", "page_number", "item_ord", "str", *(F.round(c, 6).alias(c) for c in "xywh"))


@query("SELECT doc_id, page_number, item_ord FROM rt WHERE q = 0 AND trim(str) <> ''", "item", RAW_CTES)
def b26_upright_filter(spark, d):
    return T.upright_items(raw_items(spark, d), 600.0, 800.0).select("doc_id", "page_number", "item_ord")


TURNS = "tn AS (SELECT doc_id, page_number, q AS turn, CAST(sum(length(regexp_replace(str, '\\s+', '', 'g'))) AS BIGINT) AS n, sum(sum(length(regexp_replace(str, '\\s+', '', 'g')))) OVER (PARTITION BY doc_id, page_number) AS total FROM rt GROUP BY doc_id, page_number, q)"


@query("SELECT doc_id, page_number, turn, n FROM tn WHERE turn > 0 AND n >= 40 AND n >= 0.1 * total", "item", RAW_CTES + ",\n" + TURNS)
def f7_text_quarter_turns(spark, d):
    return T.sideways_turns(raw_items(spark, d))


@query("SELECT p.doc_id, p.page_number, coalesce(list_sort(list(turn) FILTER (WHERE turn IS NOT NULL)), []) AS turns FROM pg p LEFT JOIN (SELECT * FROM tn WHERE turn > 0 AND n >= 40 AND n >= 0.1 * total) t ON t.doc_id = p.doc_id AND t.page_number = p.page_number GROUP BY p.doc_id, p.page_number".replace("coalesce(list_sort(list(turn) FILTER (WHERE turn IS NOT NULL)), []) AS turns", "coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn), '') AS turns"), "item", RAW_CTES + ",\n" + TURNS)
def r7_sideways_turns(spark, d):
    t = T.sideways_turns(raw_items(spark, d)).groupBy(*T.PAGE).agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("turns"))
    return view(spark, d, "pg").select(*T.PAGE).join(t, T.PAGE, "left").select(*T.PAGE, F.coalesce("turns", lit("")).alias("turns"))


@query(f"SELECT doc_id, page_number, item_ord, str FROM item WHERE {title_sql('str')}", "item")
def b21_index_title(spark, d):
    return items(spark, d).where(C.is_index_title(col("str"))).select("doc_id", "page_number", "item_ord", "str")


TOP = "tp AS (SELECT i.doc_id, i.page_number, string_agg(trim(str), ' ' ORDER BY x, item_ord) AS top FROM item i JOIN (SELECT doc_id, page_number, min(y) AS y0 FROM item GROUP BY ALL) m ON m.doc_id = i.doc_id AND m.page_number = i.page_number WHERE i.y - y0 < 0.01 GROUP BY i.doc_id, i.page_number)"


@query("SELECT doc_id, page_number, top FROM tp", "item", TOP)
def f14_top_line(spark, d):
    return T.top_lines(items(spark, d))


@query(f"SELECT doc_id, page_number FROM tp WHERE {head_sql('top')}", "item", TOP)
def b22_notation_head(spark, d):
    return T.top_lines(items(spark, d)).where(C.is_notation_head(col("top"))).select(*T.PAGE)


BACK = f"SELECT DISTINCT doc_id, page_number FROM item WHERE y < 0.25 AND length(trim(str)) <= 40 AND {title_sql('str')}"


@query(BACK, "item")
def b23_back_heading(spark, d):
    return I.back_headings(items(spark, d))


LINES = """inn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, item_ord) AS k FROM item WHERE y >= 0.08 AND y + h <= 1 - 0.08),
med AS (SELECT doc_id, page_number, 0.5 * CASE WHEN m = 0 THEN 0.01 ELSE m END AS tol FROM (SELECT doc_id, page_number, list_sort(list(h))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM inn GROUP BY doc_id, page_number)),
f AS (SELECT i.doc_id, i.page_number, k, x, item_ord, str, y AS ly, tol, CAST(1 AS BIGINT) AS line FROM inn i JOIN med ON med.doc_id = i.doc_id AND med.page_number = i.page_number WHERE k = 1
  UNION ALL SELECT /*r*/ i.doc_id, i.page_number, i.k, i.x, i.item_ord, i.str, CASE WHEN abs(i.y - f.ly) <= f.tol THEN f.ly ELSE i.y END, f.tol, CASE WHEN abs(i.y - f.ly) <= f.tol THEN f.line ELSE f.line + 1 END FROM f JOIN inn i ON i.doc_id = f.doc_id AND i.page_number = f.page_number AND i.k = f.k + 1),
ln AS (SELECT doc_id, page_number, line, string_agg(str, ' ' ORDER BY x, item_ord) AS text FROM f GROUP BY doc_id, page_number, line)"""


@query("SELECT doc_id, page_number, line, text FROM ln", "item", LINES)
def g2_page_lines(spark, d):
    return T.page_lines(items(spark, d)).select(*T.PAGE, F.posexplode("lines").alias("p", "text")).select(*T.PAGE, (col("p") + 1).cast("long").alias("line"), "text")


LIKE = r"lk AS (SELECT doc_id, page_number, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE regexp_matches(text, '\d+(?:\s*[–—-]\s*\d+)?(?:f|ff|n)?\s*$')) AS BIGINT) AS refs FROM ln GROUP BY doc_id, page_number)"


@query("SELECT doc_id, page_number, n, refs FROM lk WHERE refs >= 3 AND refs >= 0.3 * n", "item", LINES + ",\n" + LIKE)
def b24_looks_like_index(spark, d):
    return T.index_like(items(spark, d)).select(*T.PAGE, col("n").cast("long").alias("n"), col("refs").cast("long").alias("refs"))


PRINTED = r"pn AS (SELECT doc_id, page_number, CAST(trim(str) AS BIGINT) AS printed, min(item_ord) AS io FROM item WHERE regexp_matches(trim(str), '^\d{1,4}$') AND (y < 0.08 OR y + h > 1 - 0.08) GROUP BY ALL)"


@query("SELECT doc_id, page_number, printed FROM pn", "item", PRINTED)
def b25_printed_numbers(spark, d):
    return T.printed_numbers(items(spark, d))


OFFSET = """of AS (SELECT doc_id, "offset" FROM (SELECT doc_id, page_number - printed AS "offset", row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i * 1000 + io)) AS r FROM (
  SELECT s.doc_id, s.i, s.page_number, pn.printed, pn.io FROM (SELECT doc_id, i, CAST(least(total, greatest(1, floor((i + 0.5) * total / least(9, total) + 0.5))) AS BIGINT) AS page_number FROM (SELECT DISTINCT doc_id, total FROM pg) CROSS JOIN (SELECT range AS i FROM range(9)) WHERE i < least(9, total)) s
  JOIN pn ON pn.doc_id = s.doc_id AND pn.page_number = s.page_number WHERE pn.printed <= s.page_number + 4) GROUP BY doc_id, page_number - printed) WHERE r = 1)"""


@query('SELECT doc_id, "offset" FROM of', "item", PRINTED + ",\n" + OFFSET)
def f8_estimate_offset(spark, d):
    return I.page_offsets(docs(spark, d), items(spark, d))


RESOLVE = r"""ask AS (SELECT DISTINCT p.doc_id, s.label, p.total FROM pg p JOIN item i ON i.doc_id = p.doc_id AND i.page_number = p.page_number CROSS JOIN LATERAL (SELECT unnest(regexp_extract_all(i.str, '[0-9]+|xi|ii', 0)) AS label) s),
rs AS (SELECT a.doc_id, a.label, a.total, CASE WHEN regexp_matches(a.label, '^\d+$') THEN CAST(a.label AS BIGINT) END AS printed, (SELECT min(page_number) FROM lab WHERE lab.doc_id = a.doc_id AND lab.label = a.label) AS by_label, of."offset" FROM ask a LEFT JOIN of ON of.doc_id = a.doc_id),
gs AS (SELECT *, CASE WHEN printed <= total THEN least(total, greatest(1, printed + coalesce("offset", 0))) END AS guess FROM rs),
pr AS (SELECT g.doc_id, g.label, min_by(pn.page_number, abs(pn.page_number - g.guess) * 100000 + pn.page_number) AS probed FROM gs g JOIN pn ON pn.doc_id = g.doc_id AND pn.printed = g.printed AND abs(pn.page_number - g.guess) <= 4 WHERE "offset" IS NOT NULL AND by_label IS NULL GROUP BY g.doc_id, g.label)"""


LABELS = "[0-9]+|xi|ii"


def asked(i: DataFrame) -> DataFrame:
    return i.select("doc_id", F.explode(F.regexp_extract_all("str", lit(LABELS), lit(0))).alias("label")).distinct()


def numbered(spark, d):
    """Items with numbers, computed once: labels, folios and offsets are all read from them."""
    return kept(items(spark, d).where(col("str").rlike(LABELS)).select(*T.PAGE, "item_ord", "str", "y", "h"))


@query("SELECT g.doc_id, g.label, coalesce(by_label, probed, guess) AS page_number, by_label IS NOT NULL OR probed IS NOT NULL AS exact FROM gs g LEFT JOIN pr ON pr.doc_id = g.doc_id AND pr.label = g.label WHERE coalesce(by_label, probed, guess) IS NOT NULL", "item lab", PRINTED + ",\n" + OFFSET + ",\n" + RESOLVE)
def r5_resolve_labels(spark, d):
    i = numbered(spark, d)
    return I.resolve_labels(asked(i), docs(spark, d), view(spark, d, "lab"), i)


@query("SELECT doc_id, label, probed FROM pr", "item lab", PRINTED + ",\n" + OFFSET + ",\n" + RESOLVE)
def e10_nearest_page_probe(spark, d):
    labels = view(spark, d, "lab").select("doc_id", "label").distinct()
    out = r5_resolve_labels(spark, d)
    return out.join(labels, ["doc_id", "label"], "left_anti").where("exact").select("doc_id", "label", col("page_number").alias("probed"))


@query("SELECT doc_id, label, min(page_number) AS page_number FROM lab GROUP BY doc_id, label", "lab")
def e9_label_lookup(spark, d):
    return I.known_labels(view(spark, d, "lab"))


@query("SELECT a.doc_id, a.label, CASE WHEN NOT regexp_matches(a.label, '^[0-9]+$') THEN NULL WHEN CAST(a.label AS BIGINT) > a.total THEN NULL ELSE CAST(a.label AS BIGINT) END AS printed FROM ask a", "item lab", PRINTED + ",\n" + OFFSET + ",\n" + RESOLVE)
def b32_label_validity(spark, d):
    n = col("label").try_cast("long")
    return asked(items(spark, d)).join(docs(spark, d), "doc_id").select("doc_id", "label", F.when(col("label").rlike("^[0-9]+$") & (n <= col("total")), n).alias("printed"))


@query("SELECT doc_id, page_number, CASE WHEN page_number = 1 THEN 'i' WHEN page_number = 2 THEN 'ii' ELSE CAST(page_number - 2 AS VARCHAR) END AS label FROM pg WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT doc_id, NULL, NULL FROM pg WHERE doc_id % 3 <> 0", "lab")
def a6_page_labels(spark, d):
    """From one array of labels a document; documents without labels keep a row."""
    arrays = view(spark, d, "lab").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "label"))), lambda t: t["label"]).alias("labels"))
    listed = docs(spark, d).select("doc_id").join(arrays, "doc_id", "left")
    return listed.select("doc_id", F.posexplode_outer("labels").alias("p", "label")).select("doc_id", (col("p") + 1).cast("long").alias("page_number"), "label")


ENTRY = """en AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, ord) AS pos, CASE WHEN regexp_matches(title, '(?i)notation|symbol') THEN 0 ELSE 1 END AS notation FROM outl WHERE page_number IS NOT NULL),
nx AS (SELECT *, (SELECT min(e2.page_number) FROM en e2 WHERE e2.doc_id = en.doc_id AND e2.page_number > en.page_number) AS next_page FROM en)"""
HITS = ENTRY + f",\nht AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY notation, pos) AS hit FROM nx WHERE {title_sql('title')})"
BLOCKS = HITS + """,
bl AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY hit, page_number) AS ord FROM (SELECT doc_id, n AS page_number, min(hit) AS hit FROM (SELECT doc_id, hit, unnest(range(page_number, least(coalesce(next_page - 1, total), total, page_number + 39) + 1)) AS n FROM ht) GROUP BY doc_id, n))"""


@query("SELECT doc_id, CAST(pos AS BIGINT) AS pos, title, page_number FROM en", "outl", ENTRY)
def h8_outline_sort(spark, d):
    return I.outline_entries(view(spark, d, "outl")).select("doc_id", col("pos").cast("long").alias("pos"), "title", "page_number")


@query("SELECT doc_id, ord, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM outl) WHERE n <= 10000 AND page_number IS NOT NULL", "outl")
def h12_outline_cutoff(spark, d):
    return I.outline_entries(view(spark, d, "outl")).select("doc_id", "ord", "page_number")


@query("SELECT doc_id, ord, CAST(notation AS BIGINT) AS notation FROM en", "outl", ENTRY)
def b30_notation_first(spark, d):
    return view(spark, d, "outl").where("page_number is not null").select("doc_id", "ord", C.notation_rank(col("title")).cast("long").alias("notation"))


@query("SELECT doc_id, CAST(hit AS BIGINT) AS hit, page_number, next_page FROM ht", "outl", HITS)
def e11_next_outline_page(spark, d):
    return I.outline_hits(I.outline_entries(view(spark, d, "outl"))).select("doc_id", col("hit").cast("long").alias("hit"), "page_number", "next_page")


@query("SELECT doc_id, ord, page_number, next_page FROM nx", "outl", ENTRY)
def g4_next_greater_page(spark, d):
    later = F.min("page_number").over(Window.partitionBy("doc_id").orderBy("page_number").rangeBetween(1, Window.unboundedFollowing))
    return I.outline_entries(view(spark, d, "outl")).select("doc_id", "ord", "page_number", later.alias("next_page"))


@query("SELECT doc_id, page_number, CAST(ord AS BIGINT) AS ord FROM bl", "outl", BLOCKS)
def i7_outline_blocks(spark, d):
    return I.blocks(I.outline_hits(I.outline_entries(view(spark, d, "outl")))).select("doc_id", "page_number", col("ord").cast("long").alias("ord"))


@query("SELECT doc_id, CAST(hit AS BIGINT) AS hit, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, hit, unnest(range(page_number, least(coalesce(next_page - 1, total), total, page_number + 39) + 1)) AS n FROM ht) GROUP BY doc_id, hit", "outl", HITS)
def h7_block_cap(spark, d):
    hits = I.outline_hits(I.outline_entries(view(spark, d, "outl")))
    last = F.least(F.coalesce(col("next_page") - 1, col("total")), col("total"), col("page_number") + CONFIG.index_max_pages - 1)
    return hits.where(last >= col("page_number")).select("doc_id", col("hit").cast("long").alias("hit"), (last - col("page_number") + 1).cast("long").alias("n"))


FRONT = f"""hd AS (SELECT doc_id, page_number, page_number - row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS isl FROM tp WHERE {head_sql('top')}),
fr AS (SELECT doc_id, page_number FROM (SELECT h.doc_id, h.page_number, isl, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.page_number) AS k, min(isl) OVER (PARTITION BY h.doc_id) AS i0 FROM hd h JOIN (SELECT doc_id, min(page_number) AS f FROM hd WHERE page_number <= 40 GROUP BY doc_id) s ON s.doc_id = h.doc_id AND h.page_number >= f) WHERE isl = i0 AND k <= 8)"""


@query("SELECT doc_id, page_number FROM fr", "item", TOP + ",\n" + FRONT)
def g5_front_list(spark, d):
    return I.front_lists(items(spark, d))


HEADING = f"""bh AS (SELECT b.doc_id, min(b.page_number) AS b, t.total FROM ({BACK}) b JOIN (SELECT DISTINCT doc_id, total FROM pg) t ON t.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, max(page_number) AS lf FROM fr GROUP BY doc_id) f ON f.doc_id = b.doc_id WHERE b.page_number >= greatest(coalesce(lf + 1, 1), total - 59) GROUP BY b.doc_id, t.total),
hg AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY part, page_number) AS ord FROM (SELECT doc_id, page_number, 0 AS part FROM fr UNION ALL SELECT doc_id, unnest(range(b, least(total, b + 39) + 1)), 1 FROM bh))"""


@query("SELECT doc_id, page_number, CAST(ord AS BIGINT) AS ord FROM hg", "item", TOP + ",\n" + FRONT + ",\n" + HEADING)
def i3_front_and_back(spark, d):
    return I.heading_pages(docs(spark, d), items(spark, d)).select("doc_id", "page_number", col("ord").cast("long").alias("ord"))


@query("""SELECT doc_id, page_number, CAST(ord AS BIGINT) AS ord, CASE p WHEN 1 THEN 'outline' WHEN 2 THEN 'heading' ELSE 'fallback' END AS source FROM (SELECT *, min(p) OVER (PARTITION BY doc_id) AS best FROM (SELECT doc_id, page_number, ord, 1 AS p FROM bl UNION ALL SELECT doc_id, page_number, ord, 2 FROM hg
UNION ALL SELECT l.doc_id, l.page_number, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.page_number), 3 FROM lk l JOIN (SELECT DISTINCT doc_id, total FROM pg) t ON t.doc_id = l.doc_id WHERE refs >= 3 AND refs >= 0.3 * n AND l.page_number >= greatest(1, total - 19))) WHERE p = best""", "item outl", ",\n".join([TOP, FRONT, HEADING, BLOCKS, LINES, LIKE]))
def r3_find_index_pages(spark, d):
    return I.index_pages(docs(spark, d), view(spark, d, "outl"), items(spark, d)).select("doc_id", "page_number", col("ord").cast("long").alias("ord"), "source")


def placed(spark, d):
    """Items with their boxes, computed once: hits and the items beside and below them are read from them."""
    return kept(items(spark, d).select(*T.PAGE, "item_ord", "str", *"xywh"))


def hits(i: DataFrame) -> DataFrame:
    """The first item of each page as a hit."""
    return i.where("item_ord = 1").select(*T.PAGE, col("item_ord").alias("hit"), *"xywh")


BAND = """hb AS (SELECT doc_id, page_number, x, y, w, h FROM item WHERE item_ord = 1),
ls AS (SELECT b.doc_id, b.page_number, b.y, b.h, b.x, string_agg(i.str, '|' ORDER BY i.x, i.item_ord) AS line, list_sort(list(i.h))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM hb b LEFT JOIN item i ON i.doc_id = b.doc_id AND i.page_number = b.page_number AND i.y + i.h / 2 BETWEEN b.y - 0.35 * b.h AND b.y + b.h + 0.35 * b.h AND i.x >= b.x + b.w - 0.35 * b.h GROUP BY b.doc_id, b.page_number, b.y, b.h, b.x),
bw AS (SELECT l.doc_id, l.page_number, string_agg(i.str, '|' ORDER BY i.x, i.item_ord) AS below FROM ls l LEFT JOIN item i ON i.doc_id = l.doc_id AND i.page_number = l.page_number AND i.x >= l.x AND i.y + i.h / 2 >= l.y + l.h / 2 + 0.6 * CASE WHEN coalesce(m, 0) = 0 THEN l.h / 0.7 ELSE m END AND i.y + i.h / 2 <= l.y + l.h / 2 + 1.6 * CASE WHEN coalesce(m, 0) = 0 THEN l.h / 0.7 ELSE m END GROUP BY l.doc_id, l.page_number)"""


@query("SELECT l.doc_id, l.page_number, coalesce(line, '') AS line, coalesce(below, '') AS below FROM ls l JOIN bw ON bw.doc_id = l.doc_id AND bw.page_number = l.page_number", "item", BAND)
def e8_reference_band(spark, d):
    i = placed(spark, d)
    rows = I.line_items(hits(i), i)
    text = lambda c: F.array_join(F.transform(c, lambda t: t["s"]), "|")
    return rows.select(*T.PAGE, text("line").alias("line"), text("below").alias("below"))


LINE_REFS = r"""hm AS (SELECT b.doc_id, b.page_number, b.x, b.y, b.w, b.h, l.m FROM hb b JOIN ls l ON l.doc_id = b.doc_id AND l.page_number = b.page_number),
li AS (SELECT b.doc_id, b.page_number, 0 AS place, i.str AS s, i.x, i.x + i.w AS r, i.item_ord AS o FROM hm b JOIN item i ON i.doc_id = b.doc_id AND i.page_number = b.page_number AND i.y + i.h / 2 BETWEEN b.y - 0.35 * b.h AND b.y + b.h + 0.35 * b.h AND i.x >= b.x + b.w - 0.35 * b.h
  UNION ALL SELECT b.doc_id, b.page_number, 1, i.str, i.x, i.x + i.w, i.item_ord FROM hm b JOIN item i ON i.doc_id = b.doc_id AND i.page_number = b.page_number AND i.x >= b.x AND i.y + i.h / 2 >= b.y + b.h / 2 + 0.6 * CASE WHEN coalesce(m, 0) = 0 THEN b.h / 0.7 ELSE m END AND i.y + i.h / 2 <= b.y + b.h / 2 + 1.6 * CASE WHEN coalesce(m, 0) = 0 THEN b.h / 0.7 ELSE m END),
lg AS (SELECT *, row_number() OVER w AS i, coalesce(x - lag(r) OVER w > {gap}, false) AS wide, regexp_matches(ltrim(s), '^[0-9]') AS digit FROM li WINDOW w AS (PARTITION BY doc_id, page_number, place ORDER BY x, o)),
lt AS (SELECT doc_id, page_number, place, i, wide, digit, unnest(list_concat([NULL], ts)) AS tok, unnest(range(0, len(ts) + 1)) AS j FROM (SELECT *, regexp_extract_all(s, '{token}') AS ts FROM lg)),
lc AS (SELECT *, sum(CASE WHEN regexp_matches(tok, '^[A-Za-z]') AND NOT regexp_matches(tok, '{roman}') AND NOT regexp_matches(tok, '{suffix}') THEN 1 ELSE 0 END) OVER w AS cut, coalesce(regexp_matches(tok, '^[1-9]') OR regexp_matches(tok, '{roman}'), false) AS counts,
  coalesce(regexp_matches(tok, '^[1-9]') OR regexp_matches(tok, '{roman}') AND last_value(tok IGNORE NULLS) OVER (PARTITION BY doc_id, page_number, place ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = ',', false) AS opens FROM lt WINDOW w AS (PARTITION BY doc_id, page_number, place ORDER BY i, j ROWS UNBOUNDED PRECEDING)),
lr AS (SELECT *, counts AND bool_or(opens) OVER (PARTITION BY doc_id, page_number, place, cut ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS ref FROM lc),
lh AS (SELECT *, bool_or(ref) OVER (PARTITION BY doc_id, page_number, place, cut ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS here, bool_or(ref) OVER (PARTITION BY doc_id, page_number, place ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS seen_ref FROM lr),
le AS (SELECT *, bool_or(tok IS NULL AND wide AND (here OR seen_ref AND NOT digit)) OVER (PARTITION BY doc_id, page_number, place ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS ended FROM lh),
lz AS (SELECT *, max(cut) OVER (PARTITION BY doc_id, page_number, place) AS last_cut, min(place) OVER (PARTITION BY doc_id, page_number) AS first_place FROM le WHERE ref AND NOT ended),
lu AS (SELECT doc_id, page_number, regexp_extract(tok, '^[0-9]+|.*') AS label, min(i * 100000 + j) AS pos FROM lz WHERE cut = last_cut AND place = first_place GROUP BY doc_id, page_number, label)""".format(
    gap=CONFIG.index_max_gap, token=I.TOKEN, roman=I.ROMAN, suffix=I.SUFFIX
)


@query(f"SELECT * FROM (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) - 1 AS BIGINT) AS k, label FROM lu) WHERE k < {CONFIG.index_max_refs}", "item", BAND + ",\n" + LINE_REFS)
def g3_refs_in_line(spark, d):
    """References beside or below the first item of each page."""
    i = placed(spark, d)
    return I.page_refs(hits(i), i).select(*T.PAGE, F.col("k").cast("long").alias("k"), "label")


@query(f"SELECT doc_id, page_number, CAST(least(count(*), {CONFIG.index_max_refs}) AS BIGINT) AS n FROM lu GROUP BY doc_id, page_number", "item", BAND + ",\n" + LINE_REFS)
def h6_reference_count(spark, d):
    """References beside a hit are at most so many."""
    i = placed(spark, d)
    return I.page_refs(hits(i), i).groupBy(*T.PAGE).agg(F.count(lit(1)).alias("n"))


@query("SELECT doc_id, page_number, item_ord, str FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x, item_ord) AS k FROM item WHERE trim(str) <> '') WHERE k <= 5", "item")
def h6_reference_limit(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("x", "item_ord", "str")))
    kept = items(spark, d).where(F.trim("str") != "").groupBy(*T.PAGE).agg(F.slice(rows, 1, CONFIG.index_max_refs).alias("r"))
    return kept.select(*T.PAGE, F.explode("r").alias("r")).select(*T.PAGE, "r.item_ord", "r.str")


@query("SELECT doc_id, page_number, string_agg(str, '|' ORDER BY y, x, item_ord) AS by_y, string_agg(str, '|' ORDER BY x, item_ord) AS by_x FROM item GROUP BY doc_id, page_number", "item")
def h14_line_sorts(spark, d):
    sort = lambda *k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*k, "str"))), lambda t: t["str"]), "|")
    return items(spark, d).groupBy(*T.PAGE).agg(sort("y", "x", "item_ord").alias("by_y"), sort("x", "item_ord").alias("by_x"))


REFS = "rf AS (SELECT g.doc_id, g.label, coalesce(by_label, probed, guess) AS page_number, by_label IS NOT NULL OR probed IS NOT NULL AS exact FROM gs g LEFT JOIN pr ON pr.doc_id = g.doc_id AND pr.label = g.label WHERE coalesce(by_label, probed, guess) IS NOT NULL)"
REF_CTES = ",\n".join([PRINTED, OFFSET, RESOLVE, REFS])


@query("SELECT doc_id, string_agg('p. ' || label || CASE WHEN exact THEN '' ELSE ' ≈' END, ' · ' ORDER BY page_number, label) AS line FROM rf GROUP BY doc_id", "item lab", REF_CTES)
def s5_reference_line(spark, d):
    return display.reference_line(r5_resolve_labels(spark, d))


@query("SELECT doc_id, label, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, label) AS BIGINT) AS k FROM rf", "item lab", REF_CTES)
def h11_reference_sort(spark, d):
    return r5_resolve_labels(spark, d).select("doc_id", "label", "page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "label")).cast("long").alias("k"))


ORDER = """st AS (SELECT doc_id, max(total) AS total, 1 + doc_id % max(total) AS start FROM conv GROUP BY doc_id),
fi AS (SELECT doc_id, page_number, bytes % 7 AS pos FROM conv WHERE bytes % 5 = 0),
od AS (SELECT c.doc_id, c.page_number, row_number() OVER (PARTITION BY c.doc_id ORDER BY CASE WHEN pos IS NOT NULL THEN 0 WHEN c.page_number <= start THEN 1 ELSE 2 END, CASE WHEN pos IS NOT NULL THEN pos WHEN c.page_number <= start THEN start - c.page_number ELSE c.page_number END, c.page_number) AS ord FROM conv c JOIN st ON st.doc_id = c.doc_id LEFT JOIN fi ON fi.doc_id = c.doc_id AND fi.page_number = c.page_number)"""


def ordered(spark, d):
    c = view(spark, d, "conv")
    starts = c.groupBy("doc_id").agg(F.max("total").alias("total")).withColumn("start", 1 + col("doc_id") % col("total"))
    first = c.where("bytes % 5 = 0").select("doc_id", "page_number", (col("bytes") % 7 * 1000 + col("page_number")).alias("pos"))
    return I.scan_order(c, starts, first)


@query("SELECT doc_id, page_number, CAST(ord AS BIGINT) AS ord FROM od", "conv", ORDER)
def g10_page_order(spark, d):
    return ordered(spark, d).select("doc_id", "page_number", col("ord").cast("long").alias("ord"))


@query("SELECT doc_id, page_number FROM od", "conv", ORDER)
def i4_union_distinct_order(spark, d):
    return ordered(spark, d).select("doc_id", "page_number").dropDuplicates()


@query("SELECT doc_id, page_number AS anchor FROM od WHERE ord = 1", "conv", ORDER)
def h13_search_anchor(spark, d):
    return ordered(spark, d).groupBy("doc_id").agg(F.min_by("page_number", "ord").alias("anchor"))


SCANNED = ORDER + ", sc AS (SELECT doc_id, page_number FROM conv WHERE bytes % 3 = 0)"


def scanned(spark, d):
    return view(spark, d, "conv").where("bytes % 3 = 0").select("doc_id", "page_number")


@query("SELECT doc_id, page_number, CAST(ord AS BIGINT) AS ord FROM od WHERE (doc_id, page_number) NOT IN (SELECT doc_id, page_number FROM sc)", "conv", SCANNED)
def e12_scanned_exclusion(spark, d):
    return ordered(spark, d).join(scanned(spark, d), ["doc_id", "page_number"], "left_anti").select("doc_id", "page_number", col("ord").cast("long").alias("ord"))


@query("SELECT doc_id, page_number FROM od EXCEPT SELECT doc_id, page_number FROM sc", "conv", SCANNED)
def i5_except_scanned(spark, d):
    return ordered(spark, d).select("doc_id", "page_number").exceptAll(scanned(spark, d))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, page_number FROM sc UNION ALL (SELECT doc_id, page_number FROM od EXCEPT SELECT doc_id, page_number FROM sc)) GROUP BY doc_id", "conv", SCANNED)
def i6_union_scanned(spark, d):
    rest = ordered(spark, d).select("doc_id", "page_number").join(scanned(spark, d), ["doc_id", "page_number"], "left_anti")
    return scanned(spark, d).union(rest).groupBy("doc_id").agg(F.count(lit(1)).alias("n"))


SCOPES = """SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS ord FROM (
  SELECT od.doc_id, od.page_number, od.ord FROM od JOIN want w ON w.doc_id = od.doc_id WHERE scope = 'document' OR scope = 'page' AND od.page_number = w.page
  UNION ALL SELECT od.doc_id, od.page_number, od.ord FROM od JOIN want w ON w.doc_id = od.doc_id JOIN sc ON sc.doc_id = od.doc_id AND sc.page_number = od.page_number WHERE scope = 'index')"""
WANT = "want AS (SELECT doc_id, CASE sum(bytes) % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'document' ELSE 'index' END AS scope, max_by(page_number, bytes * 1000 + page_number) AS page FROM conv GROUP BY doc_id)"


@query(SCOPES, "conv", SCANNED + ", " + WANT)
def b29_scope(spark, d):
    """Each document searched on one page, on all, or on its index pages, in scan order."""
    c = view(spark, d, "conv")
    kind = F.sum("bytes") % 3
    want = c.groupBy("doc_id").agg(F.when(kind == 0, "page").when(kind == 1, "document").otherwise("index").alias("scope"), F.max_by("page_number", F.struct("bytes", "page_number")).alias("page"))
    return I.in_scope(ordered(spark, d), want, scanned(spark, d)).select("doc_id", "page_number", col("ord").cast("long").alias("ord"))


@query(r"""SELECT doc_id, page_number, item_ord, trim(str) AS t, regexp_replace(str, '\s+', '', 'g') AS bare, CAST(length(str) AS BIGINT) AS n FROM item""", "item")
def j1_trim_and_length(spark, d):
    return items(spark, d).select(*T.PAGE, "item_ord", F.trim("str").alias("t"), F.regexp_replace("str", r"\s+", "").alias("bare"), F.length("str").cast("long").alias("n"))


@query(f"SELECT doc_id, page_number, item_ord, array_to_string(regexp_extract_all(str, '{I.TOKEN}', 0), '|') AS tokens FROM item", "item")
def j2_tokens(spark, d):
    return items(spark, d).select(*T.PAGE, "item_ord", F.array_join(F.regexp_extract_all("str", lit(I.TOKEN), lit(0)), "|").alias("tokens"))


@query(r"""SELECT doc_id, page_number, item_ord, CASE WHEN regexp_matches(trim(str), '^\d+$') THEN CAST(trim(str) AS BIGINT) END AS n, printf('%.2f', x) AS label FROM item""", "item")
def j3_parse_and_format(spark, d):
    s = F.trim("str")
    return items(spark, d).select(*T.PAGE, "item_ord", F.when(s.rlike(r"^\d+$"), s.try_cast("long")).alias("n"), F.format_number("x", 2).alias("label"))


@query("""SELECT doc_id, page_number, item_ord, round(sqrt(x * x + y * y), 9) AS d, floor(x * 10) AS lo, ceil(y * 10) AS hi, floor(skew * 100 - 4 + 0.5) AS r, round(atan2(y, x), 9) AS t, abs(x - y) AS a FROM item""", "item")
def j4_math(spark, d):
    f = lambda c, n: c.cast("double").alias(n)
    return items(spark, d).select(*T.PAGE, "item_ord", F.round(F.hypot("x", "y"), 9).alias("d"), f(F.floor(col("x") * 10), "lo"), f(F.ceil(col("y") * 10), "hi"), f(C.half_up(col("skew") * 100 - 4), "r"), F.round(F.atan2("y", "x"), 9).alias("t"), F.abs(col("x") - col("y")).alias("a"))


@query("""SELECT doc_id, array_to_string(l[1:3], ',') AS first, list_contains(l, 'ii') AS has_ii, CAST(coalesce(list_position(l, '1'), 0) AS BIGINT) AS at_one, CAST(len(list_distinct(l)) AS BIGINT) AS n FROM (SELECT doc_id, list(label ORDER BY page_number) AS l FROM lab GROUP BY doc_id)""", "lab")
def j8_arrays(spark, d):
    rows = view(spark, d, "lab").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "label"))), lambda t: t["label"]).alias("l"))
    return rows.select("doc_id", F.array_join(F.slice("l", 1, 3), ",").alias("first"), F.array_contains("l", "ii").alias("has_ii"), F.array_position("l", "1").alias("at_one"), F.size(F.array_distinct("l")).cast("long").alias("n"))


@query('SELECT p.doc_id, p.page_number, coalesce("offset", 0) AS nullish, CASE WHEN coalesce("offset", 0) = 0 THEN 7 ELSE "offset" END AS falsy FROM pg p LEFT JOIN of ON of.doc_id = p.doc_id', "item", PRINTED + ",\n" + OFFSET)
def j11_null_defaults(spark, d):
    """A nullish default replaces null only; a falsy one also replaces 0."""
    o = I.page_offsets(docs(spark, d), items(spark, d))
    return view(spark, d, "pg").join(o, "doc_id", "left").select(*T.PAGE, F.coalesce("offset", lit(0)).alias("nullish"), F.coalesce(F.nullif(col("offset"), lit(0)), lit(7)).alias("falsy"))


OUT_TREE = """nd AS (SELECT doc_id, page_number AS node, CASE WHEN page_number > 1 THEN CAST(floor(page_number / 2) AS BIGINT) END AS parent, okey AS k, concat('T', CAST(okey AS VARCHAR)) AS title FROM pg),
f AS (SELECT doc_id, node, title, CAST(0 AS BIGINT) AS depth, [k] AS path FROM nd WHERE parent IS NULL UNION ALL SELECT /*r*/ nd.doc_id, nd.node, nd.title, f.depth + 1, list_append(f.path, nd.k) FROM f JOIN nd ON nd.doc_id = f.doc_id AND nd.parent = f.node)"""


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) AS BIGINT) AS ord, depth, title FROM f", "pg", OUT_TREE)
def a5_outline_entries(spark, d):
    parent = F.when(col("page_number") > 1, F.floor(col("page_number") / 2))
    nodes = view(spark, d, "pg").select("doc_id", col("page_number").alias("node"), parent.alias("parent"), col("okey").alias("k"), F.concat(lit("T"), col("okey").cast("string")).alias("title"), col("page_number").alias("dest"))
    return I.flatten_outline(nodes).select("doc_id", col("ord").cast("long").alias("ord"), col("depth").cast("long").alias("depth"), "title")
