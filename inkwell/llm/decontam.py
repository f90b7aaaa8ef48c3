"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are cut into lower-case runs of letters and digits. A seed hashes the
words under a fixed mask, which ignores the positions marked 0; seeds of the
test items and of the training texts are joined, and each hit is verified on
its diagonal: some window of ``WINDOW`` aligned words around it must agree in
all but ``SUBSTITUTIONS`` of them (for items of fewer words the window is the
item, with 1 substitution from 10 words on and none below). The two masks
together lie free of the substitutions for every way to place them in a window,
so the seeds lose no such overlap; in items of 10 words, where no placement is
free of the fourth word, the mask ``WHOLE`` is. Items of fewer words have one
seed, of all their words; only lengths that occur are looked for.

Seeds of the test side hold numbers only, and are broadcast if their number,
bounded by the items' words, is at most ``BROADCAST_SEEDS``; the texts' seeds are
then made and looked up in one generated loop, which copies no text. Beyond that
the two sides meet in a join salted by ``SALT``, on narrow rows, and only the hits
go back for their words. Items' words are joined to hits alone.

Defined cases: null and empty texts match nothing, on either side; repeated
items and repeated rows add no rows to the report, which has one row for each
pair of ids; a null id is an id like any other; texts and items of any length
are taken in pieces; empty tables, on either side, give an empty report; extra
columns are ignored by ``overlaps`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import durable

MASKS = ("1111101", "1011000111")
WINDOW, SUBSTITUTIONS = 13, 2
SPAN = max(map(len, MASKS))
#: For items of as many words: all but the word that every placement of the masks there covers.
WHOLE = "1110111111"
#: Most seeds (24 bytes each) and most bytes of items' words that are broadcast.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Parts that the rows of one seed, or of one item's hits, are spread over in shuffled joins.
SALT = 16
#: Of texts' places without a seed; items' are dropped.
NO_SEED = 0x5EED << 47
#: Seeds that begin in one piece of a text; a piece also has a window's words on either side.
PIECE = 128


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and word hashes. No filter follows, as Spark would evaluate the words a second time for it."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return df.select(F.col(id_col).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))


def _pieces(hashed: DataFrame, least: int) -> DataFrame:
    """Texts as pieces of bounded length, so that no row below carries more than a piece: ``h``, its place ``first`` in the text, and in ``begin``, ``end`` the places where its own seeds begin."""
    start = lambda i: F.greatest(F.lit(0), i - WINDOW)
    places = F.when(F.size("h") >= least, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - F.lit(least)), F.lit(PIECE)))
    cut = F.transform(places, lambda i: F.struct(F.slice("h", start(i) + 1, F.lit(PIECE + 2 * WINDOW + SPAN)).alias("h"), start(i).alias("first"), (i - start(i)).alias("begin")))
    rows = hashed.withColumn("c", F.explode(cut)).select(*[c for c in hashed.columns if c != "h"], "c.h", "c.first", "c.begin")
    return rows.withColumn("end", F.least(F.size("h") - least, F.col("begin") + PIECE - 1))


def _with_seeds(pieces: DataFrame, masks: list[str], fits=lambda m: F.lit(True)) -> DataFrame:
    """A row for each place ``p`` from ``begin`` to ``end`` and each mask, whether it ``fit``, and its ``seed``: NO_SEED if not, as Spark would evaluate a key twice that is null or filtered."""
    n = len(masks)
    rows = pieces.withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("end") - F.col("begin") + 1) * n - 1))).drop("end")
    rows = rows.withColumns({"p": F.col("begin") + F.shiftright("n", 1) if n == 2 else F.col("begin") + F.floor(F.col("n") / n).cast("int"), "k": F.col("n") % n}).drop("n", "begin")
    seed, fit = F.when(F.lit(False), F.lit(NO_SEED)), F.lit(False)
    for k, m in enumerate(masks):
        words = [F.get("h", F.col("p") + F.lit(i)) for i, c in enumerate(m) if c == "1"]
        here = (F.col("k") == k) & (F.col("p") <= F.size("h") - len(m)) & fits(m)
        seed, fit = seed.when(here, F.xxhash64(F.lit(m), *words)), fit | here
    return rows.withColumns({"seed": seed.otherwise(F.lit(NO_SEED)), "fit": fit}).drop("k")


def _around(h: Column, p: Column) -> list[Column]:
    """The words around a place, and where it is among them."""
    return [F.slice(h, F.greatest(F.lit(1), p + 1 - WINDOW), F.lit(3 * WINDOW)), F.least(p, F.lit(WINDOW))]


def _hits(pieces: DataFrame, test: DataFrame, masks: list[str], small: bool) -> DataFrame:
    """(id, c, pc, num, q): places of texts whose seed a place of an item has, with the words around them."""
    c, pc = _around(F.col("h"), F.col("p"))
    if small:  # the number of its rows is bounded, and they hold numbers only
        return _with_seeds(pieces, masks).join(F.broadcast(test), "seed").select("id", c.alias("c"), pc.alias("pc"), "num", "q")
    pieces = durable(pieces.withColumn("piece", F.monotonically_increasing_id()))
    narrow = _with_seeds(pieces, masks).where("fit").select("piece", "p", "seed").withColumn("salt", F.pmod(F.xxhash64("piece", "p"), F.lit(SALT)))
    found = narrow.join(_salted(test), ["seed", "salt"]).select("piece", "p", "num", "q")
    return found.join(pieces, "piece").select("id", c.alias("c"), pc.alias("pc"), "num", "q")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row for each document and item that overlap: both ids and ``n_matched``, the most aligned words that agree in a window."""
    items = _hashed(benchmark, item_col, item_text_col).where(F.size("h") > 0).select(F.monotonically_increasing_id().alias("num"), F.col("id").alias("item"), F.size("h").alias("size"), "h")
    items = durable(items)
    seen = items.agg(F.sort_array(F.collect_set(F.when(F.col("size") <= SPAN, F.col("size")))).alias("short"), F.sum("size").alias("words"), F.max("size").alias("most")).first()  # at most SPAN lengths
    masks = [*(MASKS if (seen.most or 0) >= SPAN or not seen.most else ()), *(WHOLE if n == SPAN else "1" * n for n in seen.short)]
    least, n_words = min(map(len, masks)), seen.words or 0
    fits = lambda m: F.col("size") >= SPAN if m in MASKS else F.col("size") == len(m)
    parts = _pieces(items.select("num", "size", "h"), least)
    test = _with_seeds(parts, masks, fits).where("fit").select("num", (F.col("first") + F.col("p")).alias("q"), "seed")
    w, wq = _around(F.col("h"), F.col("p"))
    words = parts.withColumn("p", F.explode(F.sequence("begin", "end"))).select("num", "size", (F.col("first") + F.col("p")).alias("q"), w.alias("w"), wq.alias("wq"))
    texts = _pieces(_hashed(docs, id_col, text_col), least).drop("first")
    hits = _hits(texts, test, masks, n_words * len(masks) <= broadcast_seeds)
    if n_words * 8 * (3 * WINDOW + 5) <= BROADCAST_BYTES and broadcast_seeds:
        both = hits.join(F.broadcast(words), ["num", "q"])  # a row for each of so many words, of bounded size
    else:
        both = hits.withColumn("salt", F.pmod(F.xxhash64("id", "pc", "c"), F.lit(SALT))).join(_salted(words), ["num", "q", "salt"])
    width = F.least(F.lit(WINDOW), F.col("size"))
    need = F.when(width == WINDOW, WINDOW - SUBSTITUTIONS).when(width >= 10, width - 1).otherwise(width)
    first = F.greatest(-F.col("q"), F.lit(min(map(len, MASKS)) - WINDOW))  # the windows that hold a mask at q
    last = F.least(F.lit(0), F.col("size") - width - F.col("q"))

    def agree(start: Column) -> Column:
        hit = lambda r: F.when(F.equal_null(F.get("c", F.col("pc") + r), F.get("w", F.col("wq") + r)), 1).otherwise(0)
        return F.aggregate(F.sequence(start, start + width - 1), F.lit(0), lambda n, r: n + hit(r))

    best = F.array_max(F.transform(F.sequence(first, F.greatest(first, last)), agree))
    found = both.select("id", "num", best.alias("n"), need.alias("need")).where("n >= need").groupBy("id", "num").agg(F.max("n").alias("n"))
    found = found.join(items.select("num", "item"), "num").groupBy("id", "item").agg(F.max("n").cast("long").alias("n_matched"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of documents that overlap with no item, with all columns. A row with a null id is dropped if any such row overlaps."""
    bad = overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias("__dc_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__dc_id"]), "left_anti")


#: The definition in DuckDB, without seeds: every diagonal of every pair of texts.
SQL = r"""
WITH d AS (SELECT doc_id, rid, w, row_number() OVER (PARTITION BY rid ORDER BY i) AS p FROM (
  SELECT doc_id, rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS ws FROM documents)) WHERE w <> ''),
b AS (SELECT item_id, w, n, p FROM (SELECT item_id, w, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY i) AS p FROM (
  SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT item_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS ws FROM benchmark)) WHERE w <> '')),
m AS (SELECT doc_id, rid, item_id, n, d.p - b.p AS diagonal, b.p AS j FROM d JOIN b ON d.w = b.w),
s AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY rid, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM m)
SELECT doc_id, item_id, CAST(max(c) AS BIGINT) AS n_matched FROM s GROUP BY doc_id, item_id, n
HAVING max(c) >= CASE WHEN n >= 13 THEN 11 WHEN n >= 10 THEN n - 1 ELSE n END
"""
