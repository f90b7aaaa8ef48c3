"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder for results: below ``spark.checkpoint.dir``, which executors share, or in a local session that has none (tests) below a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkwell-stream-")
    return f"{where}/inkwell-{uuid.uuid4().hex}"


def kept(table: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back, so that what is read often is computed once."""
    path = scratch(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
