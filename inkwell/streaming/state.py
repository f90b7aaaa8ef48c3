"""Stateful parts of the streams: generations of a document with each page once, and releases by event-time timers.

Both keep a few numbers for each key in Spark's state store, whose changes go to the
checkpoint, so that a lost executor or a restart goes on where the last batch ended.
Rows of one key and batch are put in order; across batches they must come in order, or
else count as late.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CONFIG

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start within use the store that timers and map states need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


#: Pages of a bitmap.
BLOCK = 63


class Generations(StatefulProcessor):
    """Per document the current generation and its pages. A row opens a generation (``opens``, the next number, or a ``generation`` above the current one); rows of older ones are late and dropped; each page comes out once a generation. Pages are bits, so that the store is asked once a batch for BLOCK of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "generation long")
        self.seen = handle.getMapState("seen", "block long", "bits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.current.get()
        now = start = have[0] if have is not None else 0
        fresh = have is None  # no stored page counts
        stored: dict[int, int] = {}
        bits: dict[int, int] = {}
        out: list[tuple[int, int, int]] = []
        part = pd.concat(list(rows))
        part = part.sort_values([c for c in ("ord", "tie") if c in part], kind="stable")
        for n, opens, given, page in zip(part["ord"].tolist(), part["opens"].tolist(), part["generation"].tolist(), part["page"].tolist()):
            given = None if given is None or given != given else int(given)
            if given is not None and given < now:
                continue
            if opens or given is not None and given > now:
                now = given if given is not None else now + 1
                stored, bits = {}, {}
                if not fresh:
                    self.seen.clear()
                    fresh = True
            if page is None or page != page or opens:
                continue
            block, bit = divmod(int(page), BLOCK)
            if block not in bits:
                old = None if fresh else self.seen.getValue((block,))
                bits[block] = stored[block] = old[0] if old is not None else 0
            if not bits[block] >> bit & 1:
                bits[block] |= 1 << bit
                out.append((now, int(page), int(n)))
        for block, b in bits.items():
            if b != stored[block]:
                self.seen.updateValue((block,), (b,))
        if now != start or have is None:
            self.current.update((now,))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["doc_id", "generation", "page", "ord"])

    def close(self) -> None:
        pass


def first_pages(rows: DataFrame) -> DataFrame:
    """(doc_id, generation, page, ord) of a stream of rows (doc_id, ord, opens, generation, page), and perhaps ``tie`` for rows of one ord: each page of a document's current generation, when it first comes."""
    return rows.groupBy("doc_id").transformWithStateInPandas(Generations(), "doc_id long, generation long, page long, ord long", "Append", "None")


class Releases(StatefulProcessor):
    """A tab is hidden from an event on; after ``minutes`` without another its index is released, once. A timer says so, or the next event if it comes first."""

    def __init__(self, minutes: float):
        self.micros = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ts long, event_id long")

    def due(self, since: tuple[int, int]) -> int:
        """The timer of an event, in milliseconds; a key has the one of its last event."""
        return -(-(since[0] + self.micros) // 1000)

    def rows(self, key, found: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], e, at) for e, at in found], columns=["tab", "event_id", "released_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = have = self.since.get()
        out: list[tuple[int, int]] = []
        for ts, event in sorted(r for part in rows for r in zip(part["micros"].tolist(), part["event_id"].tolist())):
            if have is not None and ts > have[0] + self.micros:
                out.append((have[1], have[0] + self.micros))
            have = (int(ts), int(event))
        self.since.update(have)
        if before is None or self.due(before) != self.due(have):
            if before is not None:
                self.handle.deleteTimer(self.due(before))
            self.handle.registerTimer(self.due(have))
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        have = self.since.get()
        self.since.clear()
        if have is not None:
            yield from self.rows(key, [(have[1], have[0] + self.micros)])

    def close(self) -> None:
        pass


def releases(events: DataFrame, minutes: float = CONFIG.release_hidden_after_min, late: str = "1 second") -> DataFrame:
    """(tab, event_id, released_at in microseconds) of a stream of events (tab, event_id, ts): the event after which a tab stayed hidden, and when its index was released."""
    timed = events.select("tab", "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("tab").transformWithStateInPandas(Releases(minutes), "tab long, event_id long, released_at long", "Append", "EventTime")
