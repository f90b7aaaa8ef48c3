"""Durable intermediate tables and bounded Arrow blocks, shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a kernel handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}
#: Spark deletes a query's shuffle files when it ends; what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets one of its own, and a cluster an error, as its executors do not share a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="inkwell-shared-")
            atexit.register(shutil.rmtree, _own[sc.applicationId][7:], ignore_errors=True)
        where = _own[sc.applicationId]
    return where


def durable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps survive lost executors and do not recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A table from ``durable`` as a relation of its own, to be joined with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._durable_path)


def discard(*frames: DataFrame) -> None:
    """Delete tables from ``durable`` that no later step reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES):
    """Yield (first row, row after the last, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
