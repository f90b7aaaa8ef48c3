"""The scores of the search's kernels at every ink pixel of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import kernels as K
from .raster import images_of


def pixel_scores(images: DataFrame, t: K.Scaled) -> DataFrame:
    """(page, oy, ox, forward, reverse) of a scaled template laid at every ink pixel of a page, by the search's own kernels."""

    def kernel(image: np.ndarray) -> dict[str, np.ndarray]:
        oy, ox = np.nonzero(image)
        h, w = t.image.shape
        area = K.Field(image, K.distance(image, CONFIG.dt_max), h, w)
        base = area.base(ox, oy, w, h)
        total, count = K.window_at(t, area, base, CONFIG.dt_max)
        return {"oy": oy, "ox": ox, "forward": K.forward_at(t, area, base), "reverse": np.where(count > 0, total / np.maximum(count, 1), 0.0)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, image in images_of(batch):
                found = kernel(image)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found["oy"]), page, np.int64)), *(pa.array(v) for v in found.values())], ["page", *found])

    return images.select("page", "w", "h", "bits").mapInArrow(run, "page long, oy long, ox long, forward double, reverse double")


def best_of(scores: DataFrame, order: list[str]) -> DataFrame:
    """The row of the highest score of each page; the first in the order on ties."""
    w = Window.partitionBy("page").orderBy(F.desc("score"), *order)
    return scores.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
