"""Page index: images to runs, components, clusters and distance transforms, one page a row.

Whole pages stay in binary columns and are worked on by Arrow kernels in place,
so no pixel table is ever made and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import kernels as K
from ..functions.columns import compact_bytes
from ..schemas import PAGE_INDEX


def images_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(page, image) of a batch of IMAGE rows; rows without a whole raster are left out, and show in ``search.scan_report``."""
    at = batch.schema.get_field_index
    for r in range(batch.num_rows):
        w, h, bits = (batch.column(at(c))[r].as_py() for c in ("w", "h", "bits"))
        if bits is not None and w and h and len(bits) == w * h:
            yield batch.column(at("page"))[r].as_py(), np.frombuffer(bits, np.uint8).reshape(h, w)


#: Reads the (page, image) pairs of a batch of rows. A source that draws its pages gives one of its own, so that they are
#: drawn in the worker that analyses them, one at a time, and no rows of images go through a second one.
Pages = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], columns: list[str], pages: Pages = images_of) -> DataFrame:
    """Rows (page, n, columns...) of a kernel that returns a table of integers for an image; n numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, image in pages(batch):
                t = kernel(image)
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), page)), pa.array(np.arange(len(t), dtype=np.int64)), *(pa.array(t[:, k].astype(np.int64)) for k in range(len(columns)))], ["page", "n", *columns])

    return images.mapInArrow(run, "page long, n long, " + ", ".join(f"{c} long" for c in columns))


def runs(images: DataFrame, pages: Pages = images_of) -> DataFrame:
    return per_image(images, K.find_runs, ["y", "x0", "x1"], pages)


def run_components(images: DataFrame) -> DataFrame:
    """Each run with the first run of its component."""

    def kernel(image: np.ndarray) -> np.ndarray:
        r = K.find_runs(image)
        return np.concatenate([r, K.components(r, image.shape[1], 1)[1][:, None]], 1)

    return per_image(images, kernel, ["y", "x0", "x1", "root"])


def components(images: DataFrame, min_pixels: int = CONFIG.min_cc_pixels) -> DataFrame:
    return per_image(images, lambda m: K.components(K.find_runs(m), m.shape[1], min_pixels)[0], list(K.BOX))


def clusters(images: DataFrame, min_pixels: int = CONFIG.min_cc_pixels, gap: int = CONFIG.cluster_gap_px) -> DataFrame:
    return per_image(images, lambda m: K.clusters(K.components(K.find_runs(m), m.shape[1], min_pixels)[0], gap), [*K.BOX, "members"])


def distances(images: DataFrame, d_max: int = CONFIG.dt_max) -> DataFrame:
    """Pixels with their distance in thirds of a pixel; for small images, as full pages have millions."""

    def kernel(m: np.ndarray) -> np.ndarray:
        d = K.distance(m, d_max)
        y, x = np.indices(d.shape)
        return np.stack([y.ravel(), x.ravel(), d.ravel()], 1)

    return per_image(images, kernel, ["y", "x", "d"])


def pixels(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """Ink pixels of a transformed image; none where the kernel returns None."""

    def table(m: np.ndarray) -> np.ndarray:
        out = kernel(m)
        return np.stack(np.nonzero(out), 1) if out is not None else np.zeros((0, 2), np.int64)

    return per_image(images, table, ["y", "x"])


def page_index(images: DataFrame, cfg: Config = CONFIG, pages: Pages = images_of) -> DataFrame:
    """Rows of PAGE_INDEX: one kernel finds runs, components and clusters of a page and stores them compactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, image in pages(batch):
                r, boxes, groups = K.analyse(image, cfg)
                h, w = image.shape
                bytes_ = 4 * (h + 1) + 4 * len(r) * (1 if w < 65536 else 2) + 20 * len(boxes) + 24 * len(groups) + 4 * len(boxes)
                columns = [
                    pa.array([page], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), one_list([np.searchsorted(r[:, 0], np.arange(h + 1))]), one_list([r[:, 1], r[:, 2] - r[:, 1] + 1], ["x0", "len"]),
                    one_list(list(boxes.T), K.BOX), one_list(list(groups.T), (*K.BOX, "members")), one_list([np.argsort(boxes[:, 0], kind="stable")]), pa.array([bytes_], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page", "w", "h", "row_start", "runs", "comps", "clusters", "by_x0", "bytes"])

    return images.mapInArrow(run, PAGE_INDEX)


def one_list(columns: list[np.ndarray], names=None) -> pa.Array:
    """A column of one list: of integers, or of structs with the names."""
    arrays = [pa.array(np.ascontiguousarray(c), pa.int32()) for c in columns]
    values = pa.StructArray.from_arrays(arrays, list(names)) if names else arrays[0]
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def expand(index: DataFrame) -> DataFrame:
    """IMAGE rows back from PAGE_INDEX."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y = np.repeat(np.arange(r["h"]), np.diff(r["row_start"]))
                t = np.array([(a["x0"], a["x0"] + a["len"] - 1) for a in r["runs"]], np.int64).reshape(-1, 2)
                image = K.image_of(np.concatenate([y[:, None], t], 1), r["w"], r["h"])
                yield pa.RecordBatch.from_arrays([pa.array([r["page"]]), pa.array([r["w"]], pa.int32()), pa.array([r["h"]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["page", "w", "h", "bits"])

    return index.select("page", "w", "h", "row_start", "runs").mapInArrow(run, "page long, w int, h int, bits binary")


def index_sizes(index: DataFrame) -> DataFrame:
    """Exact bytes of compact pages from their counts."""
    return index.select("page", compact_bytes(F.col("h"), F.size("runs"), F.size("comps"), F.size("clusters"), F.col("w")).cast("long").alias("bytes"))


def admissible(index: DataFrame, most: int = CONFIG.max_page_components) -> DataFrame:
    """Pages that are not too dense to be indexed."""
    return index.where(F.size("comps") <= most)


def cut_regions(images: DataFrame, regions: DataFrame, factor: int = 2) -> DataFrame:
    """(page, region, w, h, bits, error): the parts of pages that the boxes of ``regions`` (page, region, x, y, w, h, as shares of the page) cover, each pixel repeated ``factor`` times a side. A region that would exceed the limit of pixels, or lies off its page, has an error and no bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("asked"))
            rows: dict[str, list] = {c: [] for c in ("page", "region", "w", "h", "bits", "error")}
            whole = {page: (r, image) for r, (page, image) in ((r, x) for r in range(batch.num_rows) for x in images_of(batch.slice(r, 1)))}
            for page, (r, image) in whole.items():
                H, W = image.shape
                for b in asked[r].as_py():
                    x0, y0 = max(0, int(np.floor(b["x"] * W))), max(0, int(np.floor(b["y"] * H)))
                    x1, y1 = min(W, int(np.ceil((b["x"] + b["w"]) * W))), min(H, int(np.ceil((b["y"] + b["h"]) * H)))
                    w, h = max(0, x1 - x0) * factor, max(0, y1 - y0) * factor
                    error = "off the page" if not w * h else "too large" if w * h > CONFIG.max_snip_pixels else None
                    bits = None if error else np.repeat(np.repeat(image[y0:y1, x0:x1], factor, 0), factor, 1).tobytes()
                    for c, v in zip(rows, (page, b["region"], w, h, bits, error)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], list(rows))

    asked = regions.groupBy("page").agg(F.collect_list(F.struct(F.col("region").cast("long").alias("region"), *(F.col(c).cast("double").alias(c) for c in "xywh"))).alias("asked"))
    return images.join(asked, "page").select("page", "w", "h", "bits", "asked").mapInArrow(run, "page long, region long, w int, h int, bits binary, error string")
