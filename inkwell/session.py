"""One viewer's search session: a bound document collection, settings, searches and the current match.

Searches run under a job group of their own, so a new search or ``cancel``
stops the running one. A streamed search keeps what it has found when it is
stopped, and goes on from there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import CONFIG
from .functions import columns as C
from .functions import kernels as K
from .operators import search as S
from .streaming import pages as P

RELEASE_CHOICES = (5, 15, 30, 60)
SAVED = "index_max_mb double, release_after_min double"


def settings_of(saved: Column) -> list[Column]:
    """``index_max_mb`` and ``release_after_min`` of a JSON text, each with its default if it is missing or not valid, as ``Settings.load`` reads them from a file."""
    s = F.from_json(saved, SAVED)
    size, minutes = s["index_max_mb"], s["release_after_min"]
    fine = (size >= CONFIG.index_min_mb) & (size < float("inf"))
    return [F.when(fine, size).otherwise(CONFIG.index_max_mb).alias("index_max_mb"), F.when(minutes.isin(*map(float, RELEASE_CHOICES)), minutes).otherwise(float(CONFIG.release_hidden_after_min)).alias("release_after_min")]


@dataclass
class Settings:
    index_max_mb: float = CONFIG.index_max_mb
    release_after_min: float = CONFIG.release_hidden_after_min

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Saved settings; defaults for what is missing, invalid or unreadable."""
        out = cls()
        try:
            saved = json.loads(Path(path).read_text())
            size, minutes = saved.get("index_max_mb"), saved.get("release_after_min")
        except (OSError, ValueError, AttributeError):
            return out
        if isinstance(size, (int, float)) and not isinstance(size, bool) and CONFIG.index_min_mb <= size < float("inf"):
            out.index_max_mb = float(size)
        if minutes in RELEASE_CHOICES:
            out.release_after_min = minutes
        return out

    def save(self, path: str | Path) -> bool:
        try:
            Path(path).write_text(json.dumps(asdict(self)))
        except OSError:
            return False
        return True


class SearchSession:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, min_score: float = CONFIG.similarity_threshold):
        self.spark, self.settings, self.min_score = spark, settings or Settings(), min_score
        self.images: DataFrame | None = None
        self.matches: DataFrame | None = None
        self.group, self.current = "", -1
        self.stream: StreamingQuery | None = None
        self.out = ""

    def bind(self, images: DataFrame) -> None:
        """Bind a document's pages; results of the one before are dropped."""
        self.cancel()
        if self.matches is not None:
            self.matches.unpersist()
        self.images, self.matches, self.current = images, None, -1

    def cancel(self) -> None:
        if self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)
            self.group = ""
        if self.stream is not None:
            self.stream.stop()
            self.stream = None

    def search_streamed(self, notices: DataFrame, pages: DataFrame, template: K.Template | None, out: str, **options) -> StreamingQuery:
        """Search pages of a stored index as a stream of notices names them, page by page; ``cancel`` stops it, what was found stays, and another call with the same ``out`` goes on."""
        if template is None:
            raise ValueError("the query has no ink")
        self.cancel()
        self.out = out
        self.stream = P.start_search(notices, pages, template, out, **options)
        return self.stream

    def found(self) -> DataFrame:
        """Matches so far of a streamed search at or above the minimum score, in document order."""
        return S.shown(P.search_results(self.spark, self.out), self.min_score).orderBy("doc_id", "page", "reading_ord")

    def search(self, template: K.Template | None, pages: DataFrame | None = None, attached_ink: bool = CONFIG.attached_ink) -> DataFrame:
        """All matches down to the search floor, kept for display filters; ``pages`` (page) narrows the scope. Another attached-ink choice needs another search."""
        if self.images is None:
            raise ValueError("no document is bound")
        if template is None:
            raise ValueError("the query has no ink")
        self.cancel()
        self.group = f"search-{uuid.uuid4().hex}"
        self.spark.sparkContext.setJobGroup(self.group, "page search", interruptOnCancel=True)
        scope = self.images if pages is None else self.images.join(pages.select("page"), "page", "left_semi")
        if self.matches is not None:
            self.matches.unpersist()
        self.matches = S.page_matches(scope, template, attached_ink=attached_ink).persist()
        self.current = 0 if not self.shown().isEmpty() else -1
        return self.matches

    def shown(self) -> DataFrame:
        """Matches at or above the minimum score, in document order; no page is searched again."""
        if self.matches is None:
            raise ValueError("nothing has been searched")
        return S.shown(self.matches, self.min_score).orderBy("page", "reading_ord")

    def page_counts(self) -> DataFrame:
        """(page, n, shown) of what was found."""
        if self.matches is None:
            raise ValueError("nothing has been searched")
        return S.page_counts(self.matches, self.min_score)

    def set_min_score(self, score: float) -> None:
        """A score outside [0, 1] falls back to the default."""
        self.min_score = score if 0 <= score <= 1 else CONFIG.similarity_threshold
        self.current = -1 if self.matches is None or self.shown().isEmpty() else 0

    def step(self, direction: int) -> int:
        """The next or previous match, around the ends."""
        n = self.shown().count()
        self.current = C.stepped(self.current, direction, n) if n else -1
        return self.current

    def save_results(self, path: str) -> None:
        """Results partitioned by page; only the partitions of changed pages are written again."""
        self.shown().withColumn("page_number", F.col("page")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_number").parquet(path)
