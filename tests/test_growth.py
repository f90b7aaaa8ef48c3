"""What failed or grew too fast on larger tables, in the small."""

import tracemalloc

import compare
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions import kernels as K
from inkwell.operators import bookindex as I
from inkwell.operators import boxes as B
from inkwell.operators import raster
from inkwell.operators import textlayer as T
from inkwell.plans import ORACLES, QUERIES
from inkwell.sources.bridge import drawn, rasters, texts_of
from inkwell.streaming import pages as P
from inkwell.streaming import state

D = str(compare.DATA)


def test_outline_of_many_rows_and_levels(spark):
    """recursion in SQL stops at a number of rows, and at 100 levels."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        compare.same(spark, compare.connect(), QUERIES["a5_outline_entries"], ORACLES["a5_outline_entries"])
        chain = spark.range(1, 151).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("k"), F.col("id").cast("string").alias("title"), F.col("id").alias("dest"))
        stray = chain.where("node = 7").selectExpr("2L as doc_id", "node", "node as parent", "k", "title", "dest")  # in a circle
        assert [(r.ord, r.depth, r.title) for r in I.flatten_outline(chain.union(stray)).orderBy("ord").collect()] == [(k, k - 1, str(k)) for k in range(1, 151)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_lines_of_many_pages_are_one_batch():
    """a kernel call and a batch for a page took most of the time; columns beside the lines go through, and null texts say nothing."""
    item = pa.struct([("y", pa.float64()), ("x", pa.float64()), ("ord", pa.int64()), ("s", pa.string())])
    rows = [[(0.1, 0.5, 2, "b"), (0.104, 0.2, 1, "a"), (0.3, 0.1, 3, None)], [], [(0.1, 0.1, 1, "c")] * 2, [(0.2, 0.1, 1, None)]]
    names = ("y", "x", "ord", "s")
    lists = pa.array([[dict(zip(names, i)) for i in r] for r in rows], pa.list_(item))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), lists, pa.array([0.005] * 4)], ["page", "rows", "tol"])
    (out,) = T._page_lines(iter([batch]))
    assert out.to_pydict() == {"page": [7, 8, 9, 10], "lines": [["a b", ""], [], ["c c"], [""]]}
    (part,) = T._page_lines(iter([batch.slice(1, 2)]))
    assert part.to_pydict() == {"page": [8, 9], "lines": [[], ["c c"]]}


def reads(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


def test_index_pages_read_items_once(spark):
    """the items were read once for each sign of an index page."""
    for name in ("r3_find_index_pages", "i3_front_and_back", "g5_front_list"):
        assert reads(QUERIES[name](spark, D), "lineitem") == 1, name


def test_headings_near_the_ends(spark):
    """A front list ends at a gap and at its limit, and a heading counts behind it, within the document's last pages."""
    line = lambda doc, page, s, y=0.01: (doc, page, 1, s, 0.1, y, 0.1, 0.02)
    items = [line(1, p, "Notation") for p in (3, 4, 5, 7)] + [line(1, 5, "Index", 0.1), line(1, 90, "Index"), line(1, 30, "Index")]
    items += [line(2, p, "Symbols") for p in range(39, 60)] + [line(3, 41, "Notation"), line(4, 2, "Index")]
    items = spark.createDataFrame(items, "doc_id long, page_number long, item_ord long, str string, x double, y double, w double, h double")
    docs = spark.createDataFrame([(1, 100), (2, 60), (3, 200), (4, 3)], "doc_id long, total long")
    none = spark.createDataFrame([], "doc_id long, ord long, page_number long, total long, title string")
    want = {1: [3, 4, 5, *range(90, 101)], 2: [*range(39, 47), *range(47, 61)], 4: [2, 3]}
    got = {}
    for r in I.index_pages(docs, none, items).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.page_number)
        assert r.source == "heading" and r.ord == len(got[r.doc_id])
    assert got == want


def test_references_and_labels_read_items_once(spark):
    """F9, F11 to F14: labels, folios, hits and the items beside them come from one stored table, not from the whole join for each."""
    for name in ("h6_reference_count", "g3_refs_in_line", "e8_reference_band", "r5_resolve_labels", "s5_reference_line", "h11_reference_sort", "e10_nearest_page_probe"):
        assert reads(QUERIES[name](spark, D), "lineitem") == 0, name


def test_files_of_a_range_are_written_by_many_tasks(spark, tmp_path):
    """F7, F8: each range was one file, written by one task; a range's files make one micro-batch."""
    rows, path = spark.range(1000).select((F.col("id") * 7 % 1000).alias("at")), f"{tmp_path}/in"
    assert P.in_files(rows, "at", path, 4, file_rows=50) >= 4
    each = len(spark.read.parquet(path).inputFiles()) // 4
    assert each >= 4 and spark.read.parquet(path).count() == 1000
    got = []
    P.file_stream(spark, path, "at long", each).writeStream.foreachBatch(lambda b, _: got.append(tuple(b.agg(F.min("at"), F.max("at"), F.count("at")).first()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 4 and all(a[1] < b[0] for a, b in zip(got, got[1:])) and sum(g[2] for g in got) == 1000
    assert P.in_files(rows, "at", f"{tmp_path}/few", 4) == 1


def test_pages_of_many_blocks_come_once(spark, tmp_path):
    """pages are bits of blocks; a generation forgets the pages of the one before."""
    for ord_, generation in ((0, 1), (1000, 1), (2000, 2)):
        rows = [(1, ord_ + k, False, generation, p) for k, p in enumerate([0, 62, 63, 64, 62, 1000, 63])]
        spark.createDataFrame(rows, P.NOTICE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = P.drained(state.first_pages(P.file_stream(spark, f"{tmp_path}/in", P.NOTICE))).collect()
    assert sorted((r.generation, r.page, r.ord) for r in got) == [(g, p, o + k) for g, o in ((1, 0), (2, 2000)) for p, k in ((0, 0), (62, 1), (63, 2), (64, 3), (1000, 5))]


def test_windows_reach_few_cells(spark):
    """a window went into some nine cells of a page, and components were joined again for their ink."""
    plan = QUERIES["i8_window_and_attached"](spark, D)
    assert reads(plan, "lineitem") == 3 and B.CELL_PX >= 128


def test_clusters_of_long_narrow_pages(monkeypatch):
    """nearly all pairs of a narrow page's boxes were held at once, so that memory grew with the square of its length; cut into few pairs at a time, clusters and their order stay."""
    page = (np.random.default_rng(3).random((8000, 64)) < 0.33).astype(np.uint8)
    boxes = K.components(K.find_runs(page), 64, 4)[0]
    tracemalloc.start()
    whole = K.clusters(boxes, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(boxes) > 7000 and peak < 20e6
    monkeypatch.setattr(K, "PAIRS", 500)
    assert np.array_equal(K.clusters(boxes, 2), whole)


def test_nested_boxes_are_one_cluster(monkeypatch):
    """known pairs are cut to a box and its root where all boxes are near each other."""
    monkeypatch.setattr(K, "PAIRS", 50)
    k = np.arange(300)
    boxes = np.stack([k, k, 999 - k, 999 - k, np.ones(300, np.int64)], 1)
    assert K.clusters(boxes, 2).tolist() == [[0, 0, 999, 999, 300, 300]]


def test_documents_are_drawn_where_they_are_analysed(spark):
    """two Python workers a task held batches of texts and of their rasters."""
    for name in ("a2_page_index", "q3_label_runs"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "abc  cc\nfi"), (4, "cf il" * 700), (5, "\U0001f602é\u0300" * 90)], "id long, t string")
    images, lazily = rasters(texts, "id", "t"), texts_of(texts, "id", "t")
    for of, also in ((raster.page_index(images), raster.page_index(lazily, pages=drawn)), (raster.runs(images), raster.runs(lazily, drawn))):
        assert of.schema == also.schema and sorted(of.collect(), key=str) == sorted(also.collect(), key=str)
