"""Incremental search: notices of pages stream in, every micro-batch matches its pages from the stored index and writes its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import CONFIG
from ..functions import kernels as K
from ..operators import search as S
from ..operators.shared import scratch
from ..operators.store import stored_matches
from ..schemas import IMAGE
from .state import first_pages, state_store


#: Rows of a file of ``in_files``, about.
FILE_ROWS = 1_000_000


def in_files(rows: DataFrame, order: str, path: str, files: int, file_rows: int = FILE_ROWS) -> int:
    """Rows in ascending ranges of a column, one written after the other, as they would arrive. Returns the number of files of a range, so that as many files a micro-batch are a range.

    The bounds are approximate quantiles; empty ranges have no file. Rows are dealt evenly to a range's files.
    """
    spark = rows.sparkSession
    bounds = rows.agg(F.percentile_approx(order, F.array(*(F.lit(k / files) for k in range(1, files)))).alias("b")).first().b if files > 1 else []
    edges = sorted(set(bounds or []))
    place = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in edges), F.lit(0))
    sizes = dict(rows.where(F.col(order).isNotNull()).groupBy(place.alias("k")).count().collect())
    each = max(1, min(sizes.values(), default=0) // file_rows)
    for k in sorted(sizes) or [0]:
        part = rows.where(F.col(order).isNotNull() & (place == k))
        (part.coalesce(1) if each == 1 else part.repartition(each)).write.mode("append").parquet(path)
    return each


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """Rows of Parquet files as they appear, some files a micro-batch, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def page_stream(spark: SparkSession, path: str, pages_per_batch: int = 1) -> DataFrame:
    """IMAGE rows from Parquet files as they appear, some files a micro-batch."""
    return spark.readStream.schema(IMAGE).option("maxFilesPerTrigger", pages_per_batch).parquet(path)


def run_search(stream: DataFrame, template: K.Template, out: str, checkpoint: str, **options) -> None:
    """Match the pages of each micro-batch once (page keys are idempotent) and append MATCH rows; returns when the source is drained."""

    def one(batch: DataFrame, _: int) -> None:
        S.page_matches(batch.dropDuplicates(["page"]), template, **options).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: A notice that a page of a document is there to be searched; ``opens`` begins a new generation of the document.
NOTICE = "doc_id long, ord long, opens boolean, generation long, page long"


def start_search(notices: DataFrame, pages: DataFrame, template: K.Template, out: str, **options) -> StreamingQuery:
    """Start a search of the pages that a stream of NOTICE rows names, and return the running query.

    State drops notices of older generations and pages that came before; what is left is joined to the
    stored index ``pages``, so that a page's pixels never pass through the stream. Every micro-batch writes its
    matches once, below ``out`` under its number: one that is run again replaces them. The query may
    be stopped at any time; what it wrote stays, and another start with the same ``out`` goes on.
    """
    spark = notices.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            todo = batch.select("doc_id", "generation", "page")
            found = stored_matches(pages.join(todo.select("page").distinct(), "page", "left_semi"), template, **options)
            found.join(todo, "page").select("doc_id", "generation", *found.columns).write.mode("overwrite").parquet(f"{out}/matches/batch={number}")
            todo.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        finally:
            batch.unpersist()

    with state_store(spark):
        return first_pages(notices).writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").start()


def search_results(spark: SparkSession, out: str) -> DataFrame:
    """Matches so far of each document's newest generation (doc_id, generation, and the columns of MATCH)."""
    pages = spark.read.parquet(f"{out}/pages")
    newest = pages.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return spark.read.parquet(f"{out}/matches").drop("batch").join(newest, ["doc_id", "generation"], "left_semi")


def drain(query: StreamingQuery) -> None:
    """Wait until all that is there has been read, and stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drained(stream: DataFrame) -> DataFrame:
    """All rows of a stream's result, from a file sink: each micro-batch is written once, under its number."""
    out = scratch(stream.sparkSession)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    with state_store(stream.sparkSession):
        stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/data").select(*stream.columns)


def current_generation(events: DataFrame) -> DataFrame:
    """Adds ``generation`` to viewer events (tab, event_id, ts, kind): each ``signup`` opens a new document."""
    w = Window.partitionBy("tab").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("generation", F.sum(F.when(F.col("kind") == "signup", 1).otherwise(0)).over(w))


def live_events(events: DataFrame) -> DataFrame:
    """Events of each tab's last generation; the rest came for a document that is gone."""
    last = F.max("generation").over(Window.partitionBy("tab"))
    return current_generation(events).withColumn("last", last).where("generation = last").drop("last")


def releases(events: DataFrame, minutes: float = CONFIG.release_hidden_after_min) -> DataFrame:
    """Times at which a tab's index is released: hidden for longer than ``minutes`` until its next event."""
    before = F.lag("ts").over(Window.partitionBy("tab").orderBy("ts", "event_id"))
    gap = events.withColumn("since", before)
    return gap.where(F.col("ts") > F.col("since") + F.expr(f"make_dt_interval(0, 0, {int(minutes)}, 0)")).select("tab", "event_id", F.expr(f"since + make_dt_interval(0, 0, {int(minutes)}, 0)").alias("released_at"))


def merged_counts(stream: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows of a stream counted by key, with the smallest id: each micro-batch appends its own counts once, under its number, and these are merged."""
    out = scratch(stream.sparkSession)

    def one(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
        part.write.mode("overwrite").parquet(f"{out}/data/batch={number}")  # a batch that is run again replaces its counts

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/data").groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
