"""Page rasters as sources: image files and RGBA tables.

All give rows of IMAGE: one binary byte a pixel, ready for ``operators.raster``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import kernels as K
from ..schemas import IMAGE


def _binarised(rows: DataFrame, channels: str) -> DataFrame:
    """IMAGE from (page, w, h, n, data) with n channels a pixel; pages over the pixel limit or without a whole raster are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, h, n, data = r["w"] or 0, r["h"] or 0, r["n"], r["data"] or b""
                if not w * h or w * h > CONFIG.max_index_pixels or len(data) != w * h * n:
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(px, 3, 2) if n == 1 else px[..., 2::-1] if channels == "bgr" else px[..., :3]
                alpha = px[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)
                bits = K.binarize(np.concatenate([rgb, alpha], 2)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["page"]], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([bits], pa.binary())], ["page", "w", "h", "bits"])

    return rows.mapInArrow(run, IMAGE)


def from_rgba(pages: DataFrame) -> DataFrame:
    """From rows (page, w, h, rgba)."""
    return _binarised(pages.select(F.col("page").cast("long"), "w", "h", F.lit(4).alias("n"), F.col("rgba").alias("data")), "rgb")


def from_image_files(spark: SparkSession, path: str) -> DataFrame:
    """From image files; the page number is the last number in a file's name. Spark's reader gives BGR(A) bytes or one grey channel."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    number = F.regexp_extract("origin", r"(\d+)\D*$", 1).try_cast("long")
    return _binarised(raw.select(number.alias("page"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("n"), "data"), "bgr")
