"""Queries that drain streams: a page search by notices, generations, releases by timers, statistics observed on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import store
from ..sources.bridge import view
from ..streaming import pages as P
from ..streaming import state
from .raster_queries import EVENTS, images, symbol
from .registry import query
from .store_queries import CANDIDATES, MARK, MARK_SQL, gate_sql, kept

col, lit = F.col, F.lit
FILES = 4


def notices(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as pages of documents of four: some come for a first generation, all for a second one, some twice, and some late for the first."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(col("item_id").cast("long").alias("page"), F.floor(col("item_id") / 4).cast("long").alias("doc_id"))
    one = lambda rows, base, generation: rows.select("doc_id", (lit(base) + col("page")).cast("long").alias("ord"), lit(False).alias("opens"), lit(generation).cast("long").alias("generation"), "page")
    step = 1 << 40
    parts = [one(b.where("page % 2 = 0"), 0, 1), one(b.where("page % 4 < 2"), step, 2), one(b.where("page % 3 = 0"), 2 * step, 1), one(b.where("page % 4 >= 1"), 3 * step, 2)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query()
def l1_page_search_stream(spark, d):
    """Pages searched as notices of them stream in; the newest generation's matches are those of the whole search."""
    out = P.scratch(spark)
    pages = kept(store.stored_index(images(spark, d, glyphs=True)))
    each = P.in_files(notices(spark, d), "ord", f"{out}/notices", FILES)
    P.drain(P.start_search(P.file_stream(spark, f"{out}/notices", P.NOTICE, each), pages, symbol(1), f"{out}/search"))
    return P.search_results(spark, f"{out}/search").drop("doc_id", "generation")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Viewer events as a stream of files of ascending times."""
    e = view(spark, d, "ev")
    path = f"{P.scratch(spark)}/events"
    timed = e.withColumn("at", F.unix_micros(col("ts").cast("timestamp")))
    return P.file_stream(spark, path, timed.schema, P.in_files(timed, "at", path, FILES))


@query("SELECT DISTINCT tab, generation, page FROM (SELECT tab, CAST(generation AS BIGINT) AS generation, page FROM gen WHERE kind = 'view')", "ev", EVENTS)
def l4_stream_builds(spark, d):
    """Each page once a generation, from a stream of viewer events whose signups open generations."""
    e = event_stream(spark, d).where("kind IN ('view', 'signup')")
    rows = e.select(col("tab").alias("doc_id"), col("at").alias("ord"), col("event_id").alias("tie"), (col("kind") == "signup").alias("opens"), lit(None).cast("long").alias("generation"), "page")
    return P.drained(state.first_pages(rows)).select(col("doc_id").alias("tab"), "generation", "page")


@query(
    """SELECT tab, event_id, CAST(epoch_us(ts) + 1800000000 AS BIGINT) AS released_at FROM (SELECT *, lead(ts) OVER (PARTITION BY tab ORDER BY ts, event_id) AS next, max(ts) OVER () AS last FROM ev)
WHERE next > ts + INTERVAL 30 MINUTE OR next IS NULL AND ts + INTERVAL 30 MINUTE <= last - INTERVAL 1 SECOND""",
    "ev",
)
def l7_release_timers(spark, d):
    """Releases of hidden tabs by event-time timers, from a drained stream; the last event of a tab counts once the stream's time has passed it."""
    return P.drained(state.releases(event_stream(spark, d)))


@query(
    f"""SELECT CAST((SELECT count(*) FROM cand) * {len(MARK.anchors)} AS BIGINT) AS candidates, CAST(count(*) AS BIGINT) AS gated, CAST(count(*) * 27 AS BIGINT) AS scored, CAST((SELECT count(*) FROM benchmark) AS BIGINT) AS pages, CAST(0 AS BIGINT) AS failed
FROM cand c JOIN mark ON {gate_sql(str(float(MARK.image.shape[0])))}""",
    ctes=CANDIDATES + ",\n" + MARK_SQL,
)
def f13_search_statistics(spark, d):
    """What the search's kernel counted, observed in the pass that found the matches."""
    seen = Observation("search")
    S.search_observed(images(spark, d), MARK, seen).write.format("noop").mode("overwrite").save()
    names = ["candidates", "gated", "scored", "pages", "failed"]
    return spark.createDataFrame([tuple(seen.get[c] for c in names)], ", ".join(f"{c} long" for c in names))
