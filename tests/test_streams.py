"""Streams: page search by notices, stopping and going on, generations, observed statistics; and the data source of pages."""

import random
import time

import compare
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from inkwell.operators import search as S
from inkwell.operators import store
from inkwell.plans import QUERIES
from inkwell.plans.raster_queries import images, symbol
from inkwell.sources import page_source
from inkwell.streaming import pages as P
from inkwell.streaming import state

D = str(compare.DATA)
FIELDS = ("page", "reading_ord", "x_norm", "y_norm", "w_norm", "h_norm", "score")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Eight glyph pages, and their stored index."""
    pages = images(spark, D, glyphs=True).where("page < 8")
    path = str(tmp_path_factory.mktemp("few") / "pages")
    store.stored_index(pages).write.parquet(path)
    return pages, spark.read.parquet(path)


def write(spark, path, notices):
    """One file of (doc_id, ord, opens, generation, page)."""
    spark.createDataFrame(notices, P.NOTICE).coalesce(1).write.mode("append").parquet(path)


def test_streamed_search_equals_the_whole(spark):
    assert rows(QUERIES["l1_page_search_stream"](spark, D), *FIELDS) == rows(QUERIES["r2_page_matches"](spark, D), *FIELDS)


def test_older_generations_are_dropped_and_pages_come_once(spark, few, tmp_path):
    pages, stored = few
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, path, [(1, 1, False, 1, 0), (1, 2, False, 1, 1), (2, 1, False, 1, 6), (2, 2, False, 1, 6)])
    write(spark, path, [(1, 3, False, 2, 2), (1, 4, False, 2, 2), (1, 5, False, 1, 5)])
    write(spark, path, [(1, 6, False, 1, 3), (1, 7, False, 2, 2), (1, 8, False, 2, 4), (2, 3, False, 1, 6)])
    P.drain(P.start_search(P.file_stream(spark, path, P.NOTICE), stored, symbol(1), out))
    assert rows(spark.read.parquet(f"{out}/pages"), "doc_id", "generation", "page") == [(1, 1, 0), (1, 1, 1), (1, 2, 2), (1, 2, 4), (2, 1, 6)]
    want = S.page_matches(pages.where("page IN (2, 4, 6)"), symbol(1))
    assert rows(P.search_results(spark, out), *FIELDS) == rows(want, *FIELDS) and want.count()


def test_stopped_search_keeps_its_pages_and_goes_on(spark, few, tmp_path):
    """After two batches the rows are exactly those of their pages; another start reads the rest and nothing twice."""
    pages, stored = few
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(8):
        write(spark, path, [(1, k, False, 1, k)])
    stream = P.file_stream(spark, path, P.NOTICE)
    query = P.start_search(stream, stored, symbol(1), out)
    end = time.time() + 120
    while time.time() < end and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
        time.sleep(0.05)
    query.stop()
    done = [p for (p,) in rows(spark.read.parquet(f"{out}/pages"), "page")]
    assert 2 <= len(done) < 8 and done == list(range(len(done)))
    assert rows(P.search_results(spark, out), *FIELDS) == rows(S.page_matches(pages.where(F.col("page") < len(done)), symbol(1)), *FIELDS)
    P.drain(P.start_search(P.file_stream(spark, path, P.NOTICE), stored, symbol(1), out))
    assert rows(spark.read.parquet(f"{out}/pages"), "page") == [(k,) for k in range(8)]
    assert rows(P.search_results(spark, out), *FIELDS) == rows(S.page_matches(pages, symbol(1)), *FIELDS)


def test_session_cancels_and_goes_on(spark, few, tmp_path):
    """A session's streamed search is cancelled after a batch, shows what it found, and is taken up again."""
    from inkwell.session import SearchSession

    pages, stored = few
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(6):
        write(spark, path, [(1, k, False, 1, k)])
    session = SearchSession(spark, min_score=0.8)
    with pytest.raises(ValueError):
        session.search_streamed(P.file_stream(spark, path, P.NOTICE), stored, None, out)
    query = session.search_streamed(P.file_stream(spark, path, P.NOTICE), stored, symbol(1), out)
    end = time.time() + 120
    while time.time() < end and query.lastProgress is None:
        time.sleep(0.05)
    session.cancel()
    done = [p for (p,) in rows(spark.read.parquet(f"{out}/pages"), "page")]
    shown = lambda n: rows(S.shown(S.page_matches(pages.where(F.col("page") < n), symbol(1)), 0.8), *FIELDS)
    assert not query.isActive and 1 <= len(done) < 6 and rows(session.found(), *FIELDS) == shown(len(done))
    P.drain(session.search_streamed(P.file_stream(spark, path, P.NOTICE), stored, symbol(1), out))
    assert rows(session.found(), *FIELDS) == shown(6)


def test_generations_equal_a_double(spark, tmp_path):
    rng = random.Random(3)
    notices, path = [], f"{tmp_path}/in"
    for _ in range(3):
        part = [(rng.randrange(3), len(notices) + k, rng.random() < 0.1, rng.choice([None, None, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4])) for k in range(60)]
        write(spark, path, part)
        notices += part
    now, seen, want = {}, {}, []
    for doc, n, opens, given, page in notices:
        at = now.setdefault(doc, 0)
        if given is not None and given < at:
            continue
        if opens or given is not None and given > at:
            now[doc] = given if given is not None else at + 1
            seen[doc] = set()
        if not opens and page is not None and page not in seen.setdefault(doc, set()):
            seen[doc].add(page)
            want.append((doc, now[doc], page, n))
    got = P.drained(state.first_pages(P.file_stream(spark, path, P.NOTICE)))
    assert rows(got, "doc_id", "generation", "page", "ord") == sorted(want)


def test_observed_search(spark, few):
    """One pass gives the matches and the kernel's counts, with failed pages among them."""
    pages = few[0].unionByName(spark.createDataFrame([(900, 5, 5, bytearray(b"short"))], few[0].schema))
    seen = Observation("test")
    found = S.search_observed(pages, symbol(1), seen, threshold=0.9)
    got = rows(found.where("error is null"), *FIELDS)
    assert got == rows(S.page_matches(pages, symbol(1), threshold=0.9), *FIELDS)
    stats = S.match_statistics(pages, symbol(1), threshold=0.9).where("error is null")
    total = stats.agg(*(F.sum(c).alias(c) for c in S.STATS)).first().asDict()
    assert seen.get == total | {"matches": len(got), "pages": 8, "failed": 1} and total["pruned"] > 0


def test_page_source_prunes(spark, few, tmp_path):
    path = f"{tmp_path}/ranges"
    page_source.write_pages(few[1], path, 2)
    df = page_source.read_pages(spark, path)
    whole = rows(few[1], "page", "w", "h", "runs", "comps", "clusters", "error")
    assert rows(df, "page", "w", "h", "runs", "comps", "clusters", "error") == whole and df.rdd.getNumPartitions() == 4
    asked = [({"first": 5, "last": 5}, 1), ({"first": 3, "last": 5}, 2), ({"pages": [0, 7]}, 2), ({"first": 7}, 1), ({"pages": []}, 0), ({"last": 3, "pages": [3, 5]}, 1), ({"last": 99}, 4), ({"first": 100}, 0)]
    for options, ranges in asked:
        part = page_source.read_pages(spark, path, **options)
        want = [p for p in range(8) if options.get("first", 0) <= p <= options.get("last", 99) and p in options.get("pages", range(8))]
        assert rows(part, "page") == [(p,) for p in want] and part.rdd.getNumPartitions() == max(ranges, 1), options
    one, two = df.where("page = 5"), df.where("page = 6")
    assert rows(one.union(two), "page") == [(5,), (6,)] and df.count() == 8  # filters are Spark's, so that none outlives its scan
    assert df.select("page").count() == 8 and rows(df.where("page > 3").select("h"), "h") == rows(few[1].where("page > 3").select("h"), "h")
    assert rows(store.stored_matches(page_source.read_pages(spark, path, last=3), symbol(1)), *FIELDS) == rows(S.page_matches(few[0].where("page < 4"), symbol(1)), *FIELDS)
    assert len(page_source.StoredPages({"path": "file://" + path}).reader(few[1].schema).partitions()) == 4
    with pytest.raises(ValueError):
        page_source.StoredPages({}).reader(few[1].schema)
