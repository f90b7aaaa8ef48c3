"""Views of the driver's tables in the engine's shapes.

Each view is one SQL text that Spark and DuckDB both run, over whole tables, but
that Spark has a text of its own for ``item``, which moves less; the two rasters that need characters or pixels one by one have a kernel for Spark
and SQL for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import IMAGE

VIEWS = {
    # boxes on pages, with ink and a score
    "box": """
SELECT page, ord, x, y, w, h, x + w - 1 AS x1, y + h - 1 AS y1, ink, score FROM (
  SELECT CAST(l_orderkey AS BIGINT) AS page,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ord,
    CAST(l_partkey * 7 % 97 AS BIGINT) AS x, CAST(l_suppkey * 5 % 61 AS BIGINT) AS y, CAST(4 + l_partkey % 23 AS BIGINT) AS w, CAST(4 + l_suppkey % 19 AS BIGINT) AS h,
    CAST(1 + (l_partkey + l_suppkey) % 16 AS BIGINT) AS ink, CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 1000 AS DOUBLE) / 1000 AS score
  FROM {lineitem}) AS b""",
    # customers as documents, their orders as pages
    "pg": """
SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS page_number,
  CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS total, CAST(o_orderkey AS BIGINT) AS okey, o_orderstatus AS status
FROM {orders}""",
    # lines of orders as text items
    "item": """
SELECT p.doc_id, p.page_number, p.total, CAST(row_number() OVER (PARTITION BY p.doc_id, p.page_number ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS BIGINT) AS item_ord,
  CASE (l.l_partkey + l.l_linenumber) % 12
    WHEN 0 THEN CAST(p.page_number + l.l_suppkey % 3 AS {text})
    WHEN 1 THEN concat(t.p_name, ', ', CAST(1 + l.l_suppkey % 12 AS {text}))
    WHEN 2 THEN concat(t.p_type, ' ', CAST(1 + l.l_suppkey % 9 AS {text}), '-', CAST(3 + l.l_suppkey % 9 AS {text}))
    WHEN 3 THEN 'Subject Index'
    WHEN 4 THEN concat('List of Symbols ', CAST(p.page_number AS {text}))
    WHEN 5 THEN concat(t.p_name, ', ', CAST(1 + l.l_suppkey % 12 AS {text}), ' (definition)')
    WHEN 6 THEN concat('xi, ', CAST(1 + l.l_suppkey % 12 AS {text}), 'ff')
    WHEN 7 THEN 'Index theorem'
    WHEN 8 THEN concat(CAST(p.page_number AS {text}), ' Notation')
    WHEN 9 THEN '  '
    ELSE concat(CAST(1 + l.l_suppkey % 14 AS {text}), ', ', CAST(2 + l.l_suppkey % 14 AS {text})) END AS str,
  CAST(l.l_suppkey % 20 AS DOUBLE) / 25 AS x, CAST(l.l_partkey % 40 AS DOUBLE) / 41 AS y, 0.05 + CAST(l.l_partkey % 7 AS DOUBLE) / 100 AS w, 0.02 + CAST(l.l_linenumber % 3 AS DOUBLE) / 100 AS h,
  CAST((l.l_partkey + l.l_suppkey) % 4 AS BIGINT) AS turn, CAST(l.l_suppkey % 9 AS DOUBLE) / 50 AS skew
FROM pg p JOIN {lineitem} l ON l.l_orderkey = p.okey JOIN {part} t ON t.p_partkey = l.l_partkey""",
    # outline entries; some destinations are broken
    "outl": """
SELECT doc_id, CAST(okey * 7 % 1009 AS BIGINT) AS ord, CASE WHEN okey % 13 = 0 THEN NULL ELSE page_number END AS page_number, total,
  CASE okey % 9 WHEN 0 THEN 'Index' WHEN 1 THEN 'Index theory' WHEN 2 THEN 'Appendix B. Notation' WHEN 3 THEN 'List of symbols' ELSE concat('Chapter ', CAST(page_number AS {text})) END AS title
FROM pg WHERE doc_id % 2 = 0""",
    # printed page labels of a third of the documents
    "lab": """
SELECT doc_id, page_number, CASE WHEN page_number = 1 THEN 'i' WHEN page_number = 2 THEN 'ii' ELSE CAST(page_number - 2 AS {text}) END AS label FROM pg WHERE doc_id % 3 = 0""",
    # conversations as documents of pages, with bytes
    "conv": """
SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn + 1 AS BIGINT) AS page_number, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS total, CAST(200 + length(text) % 1000 AS BIGINT) AS bytes, role
FROM {conversations}""",
    # viewer events of tabs
    "ev": """
SELECT CAST(user_id AS BIGINT) AS tab, CAST(event_id AS BIGINT) AS event_id, ts, event_type AS kind, CAST(1 + event_id % 20 AS BIGINT) AS page, value FROM {events}""",
}
# The same rows for Spark: names are put together before lines move to their orders, and a page's items are numbered
# where its order's lines already are. What the number's order leaves out could not tell items apart.
SPARK_VIEWS = {
    "item": """
SELECT p.doc_id, p.page_number, p.total, CAST(row_number() OVER (PARTITION BY p.okey, p.doc_id, p.page_number ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS BIGINT) AS item_ord,
  CASE (l.l_partkey + l.l_linenumber) % 12
    WHEN 0 THEN CAST(p.page_number + l.l_suppkey % 3 AS STRING)
    WHEN 1 THEN concat(l.name, ', ', CAST(1 + l.l_suppkey % 12 AS STRING))
    WHEN 2 THEN concat(l.name, ' ', CAST(1 + l.l_suppkey % 9 AS STRING), '-', CAST(3 + l.l_suppkey % 9 AS STRING))
    WHEN 3 THEN 'Subject Index'
    WHEN 4 THEN concat('List of Symbols ', CAST(p.page_number AS STRING))
    WHEN 5 THEN concat(l.name, ', ', CAST(1 + l.l_suppkey % 12 AS STRING), ' (definition)')
    WHEN 6 THEN concat('xi, ', CAST(1 + l.l_suppkey % 12 AS STRING), 'ff')
    WHEN 7 THEN 'Index theorem'
    WHEN 8 THEN concat(CAST(p.page_number AS STRING), ' Notation')
    WHEN 9 THEN '  '
    ELSE concat(CAST(1 + l.l_suppkey % 14 AS STRING), ', ', CAST(2 + l.l_suppkey % 14 AS STRING)) END AS str,
  CAST(l.l_suppkey % 20 AS DOUBLE) / 25 AS x, CAST(l.l_partkey % 40 AS DOUBLE) / 41 AS y, 0.05 + CAST(l.l_partkey % 7 AS DOUBLE) / 100 AS w, 0.02 + CAST(l.l_linenumber % 3 AS DOUBLE) / 100 AS h,
  CAST((l.l_partkey + l.l_suppkey) % 4 AS BIGINT) AS turn, CAST(l.l_suppkey % 9 AS DOUBLE) / 50 AS skew
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_partkey + l_linenumber) % 12 WHEN 1 THEN p_name WHEN 2 THEN p_type WHEN 5 THEN p_name END AS name
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) l JOIN pg p ON p.okey = l.l_orderkey""",
}
NEEDS = {"item": ["pg"], "outl": ["pg"], "lab": ["pg"]}
_TABLE = re.compile(r"\{(\w+)\}")


def duck(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    out: dict[str, str] = {}
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            out[m] = _TABLE.sub(lambda x: "VARCHAR" if x[1] == "text" else x[1], VIEWS[m])
    return ",\n".join(f"{k} AS ({v})" for k, v in out.items())


def view_of(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A view that needs no other one, over the given tables, which may be streams."""
    return spark.sql(VIEWS[name].replace("{text}", "STRING"), **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view in Spark."""
    sql = SPARK_VIEWS.get(name, VIEWS[name]).replace("{text}", "STRING")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))}
    for n in NEEDS.get(name, []):
        frames[n] = view(spark, sf_dir, n)
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **frames)


# rasters

WIDTH = 64
# Eight stroke bitmaps of 5 x 7, rows top to bottom, chosen by code point modulo 8.
GLYPHS = (
    "10000 10000 10000 10000 10000 10000 11111", "11111 00100 00100 00100 00100 00100 00100", "11111 10001 10001 10001 10001 10001 11111", "00100 00100 00100 11111 00100 00100 00100",
    "10001 10001 10001 10001 10001 10001 11111", "11111 10000 10000 11110 10000 10000 11111", "11111 10000 10000 10000 10000 10000 11111", "11111 10001 10001 11111 10001 10001 10001",
)
CELL_W, CELL_H, STROKE, PER_LINE = 20, 28, 3, 40


def glyph(k: int) -> np.ndarray:
    rows = np.array([[int(c) for c in row] for row in GLYPHS[k].split()], np.uint8)
    return np.kron(rows, np.ones((STROKE, STROKE), np.uint8))


def text_raster(text: str) -> np.ndarray:
    """A pixel for each character, WIDTH to a row; ink where it is no blank and its code point is a multiple of three."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    ink = (cp % 3 == 0) & (cp != 32) & ~((cp >= 9) & (cp <= 13))
    h = max(1, -(-len(cp) // WIDTH))
    out = np.zeros(h * WIDTH, np.uint8)
    out[: len(cp)] = ink
    return out.reshape(h, WIDTH)


def glyph_raster(text: str) -> np.ndarray:
    """A page of glyphs, PER_LINE to a line; blanks draw nothing."""
    lines = max(1, -(-len(text) // PER_LINE))
    out = np.zeros((lines * CELL_H, PER_LINE * CELL_W), np.uint8)
    shapes = [glyph(k) for k in range(8)]
    for p, c in enumerate(text):
        if not c.isspace():
            y, x = p // PER_LINE * CELL_H, p % PER_LINE * CELL_W
            g = shapes[ord(c) % 8]
            out[y : y + g.shape[0], x : x + g.shape[1]] = g
    return out


#: A dense page at scale 3: its size, glyphs, glyphs in a line, and their distances.
LARGE_W, LARGE_H, LARGE_GLYPHS, LARGE_LINE, LARGE_DX, LARGE_DY = 1836, 2376, 1400, 60, 30, 98


def large_raster(text: str) -> np.ndarray:
    """A page of the size and density of a textbook's: the text's glyphs again and again; a longer text makes a longer page."""
    letters = [ord(c) % 8 for c in text if not c.isspace()]
    n = max(LARGE_GLYPHS, len(letters)) if letters else 0
    out = np.zeros((max(LARGE_H, (-(-n // LARGE_LINE) - 1) * LARGE_DY + 61), LARGE_W), np.uint8)
    shapes = [glyph(k) for k in range(8)]
    for p in range(n):
        y, x = p // LARGE_LINE * LARGE_DY + 20, p % LARGE_LINE * LARGE_DX + 20
        g = shapes[letters[p % len(letters)]]
        out[y : y + g.shape[0], x : x + g.shape[1]] = g
    return out


def texts_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (i, t) to be drawn."""
    return texts.selectExpr(f"cast(`{id_col}` as bigint) as i", f"`{text_col}` as t")


def drawn(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(page, ``text_raster``) of a batch of ``texts_of``, for kernels of ``operators.raster``; null counts as empty."""
    for i, t in zip(*batch.columns):
        yield i.as_py(), text_raster(t.as_py() or "")


def rasters(texts: DataFrame, id_col: str, text_col: str, glyphs: bool = False, large: bool = False) -> DataFrame:
    """Rows of IMAGE for texts; null counts as empty."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 8 if large else 64
            for i in range(0, batch.num_rows, step):
                rows = batch.slice(i, step).to_pylist()
                images = [(large_raster if large else glyph_raster if glyphs else text_raster)(r["t"] or "") for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["i"] for r in rows], pa.int64()), pa.array([m.shape[1] for m in images], pa.int32()), pa.array([m.shape[0] for m in images], pa.int32()), pa.array([m.tobytes() for m in images], pa.binary())],
                    ["page", "w", "h", "bits"],
                )

    return texts_of(texts, id_col, text_col).mapInArrow(draw, IMAGE)


def duck_pixels(table: str, id_col: str) -> str:
    """DuckDB: px(page, y, x, ink) of ``text_raster``."""
    return f"""px AS (SELECT page, (p - 1) // {WIDTH} AS y, (p - 1) % {WIDTH} AS x, CASE WHEN unicode(c) % 3 = 0 AND unicode(c) <> 32 AND NOT unicode(c) BETWEEN 9 AND 13 THEN 1 ELSE 0 END AS ink FROM (
  SELECT CAST({id_col} AS BIGINT) AS page, unnest(string_split(text, '')) AS c, CAST(generate_subscripts(string_split(text, ''), 1) AS BIGINT) AS p FROM {table}))"""
