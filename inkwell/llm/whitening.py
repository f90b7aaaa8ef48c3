"""Embedding whitening by a tall-skinny QR of the exactly centred vectors.

Each entry ``c`` becomes the integer ``x = floor(SCALE * c) + SHIFT``. Integer sums
per dimension are exact, so ``n * x - S`` is an exact integer that sums to zero in
every dimension; divided by n it is the centred entry. Every partition reduces its
centred rows to one triangular factor, block by block; the factors meet in groups
of ``FAN``, level by level, until one is left. Its singular values and right
vectors, found on the driver for one matrix of dimension x dimension, give
variances and components. No covariance of the input is formed, and no vector is
shuffled: the table is scanned for its dimension, for the sums, for the factors, for
the check and for the result, and all else is as large as the dimension.

Components are numbered from 1 by falling variance; of each, the entry of the largest
size is positive. Components of equal variance are any orthonormal set of their space.

Defined cases: rows whose vector is null, or holds a null, a NaN or an infinity, or an
entry whose integer a long does not hold, are left out; the dimension is the length
that most of the other rows have (of equally frequent ones the larger), and rows of
another length, empty ones too, lack entries and are left out; repeated rows count
each; a null id is kept; with no variance left along a component (constant dimensions,
fewer rows than dimensions, a single row) ``whitened`` is null and ``explained`` 0, or
null if there is no variance at all; ``identity_error`` is over the others, and null
without any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import discard, durable

SCALE, SHIFT = 64, 1_000_000
#: Rows of a block that is reduced at once, at least as many times the dimension.
BLOCK_ROWS, BLOCK_FACTOR = 4096, 4
#: Triangular factors that one task merges.
FAN = 16
#: Entries that are worked on at once.
PART = 1 << 20
#: Integers from here on count as infinite.
LARGEST = 2.0**62
EPS = float(np.finfo(float).eps)


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values as doubles with nulls as NaN, length of each list or -1 for null, where each list begins)."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.diff(column.offsets.to_numpy())
    begin = column.offsets.to_numpy()[:-1]
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, size)
    flat = column.values
    return flat.to_numpy(zero_copy_only=False).astype(float), size, begin


def integers(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that remain, their integers), in parts of bounded size."""
    flat, size, begin = entries(column)
    rows, step = np.flatnonzero(size == dim), max(1, PART // dim)
    for i in range(0, len(rows), step):
        row = rows[i : i + step]
        x = np.floor(SCALE * flat[begin[row][:, None] + np.arange(dim)])
        ok = (np.abs(x) < LARGEST).all(axis=1)  # false for NaN and infinities
        yield row[ok], x[ok].astype(np.int64) + SHIFT


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by length, of those without a bad entry."""
    seen: dict[int, int] = {}
    for batch in batches:
        flat, size, begin = entries(batch.column(0))
        good = np.append(0, np.cumsum(~(np.abs(np.floor(SCALE * flat)) < LARGEST)))
        ok = (size > 0) & (good[begin + np.maximum(size, 0)] == good[begin])
        for k, n in zip(*np.unique(size[ok], return_counts=True)):
            seen[int(k)] = seen.get(int(k), 0) + int(n)
    yield pa.RecordBatch.from_pydict({"dim": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})


def partial_sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each dimension and task, as decimals."""
    total = np.zeros(dim, object)
    for batch in batches:
        for _, x in integers(batch.column(0), dim):
            high, low = x >> 32, x & 0xFFFFFFFF  # neither half's sum leaves 64 bits
            total += high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
    yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(dim)), "s": pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))})


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they hold it, else as Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(dev: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the rows."""
    if dev.dtype == np.int64 and dev.shape[1] * int(np.abs(dev).max(initial=0)) ** 2 < 2**62:
        return (dev * dev).sum(1)
    dev = dev.astype(object)
    return (dev * dev).sum(1)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def packed(factors: list[np.ndarray], key: int) -> pa.RecordBatch:
    """One row for the merged factors."""
    r = np.ascontiguousarray(triangle(np.concatenate(factors)))
    return pa.RecordBatch.from_pydict({"k": pa.array([key], pa.int64()), "rows": pa.array([len(r)], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})


def unpacked(table, dim: int) -> list[np.ndarray]:
    return [np.frombuffer(v, float).reshape(n, dim) for n, v in zip(table.column("rows").to_pylist(), table.column("r").to_pylist())]


FACTOR = "k long, rows int, r binary"


def _factors(batches: Iterator[pa.RecordBatch], dim: int, n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    """One triangular factor of a partition's centred rows."""
    most = max(BLOCK_ROWS, BLOCK_FACTOR * dim)
    have: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, x in integers(batch.column(0), dim):
            have.append(deviations(x, n, sums).astype(float) / n)
            size += len(x)
            if size >= most:
                have = [triangle(np.concatenate(have))]
                size = len(have[0])
    if have:
        yield packed(have, TaskContext.get().partitionId())


def _merge(table: pa.Table, dim: int) -> pa.Table:
    table = table.sort_by("k")
    return pa.Table.from_batches([packed(unpacked(table, dim), table.column("g")[0].as_py())])


@dataclass
class Whitening:
    """What a fit learned: ``axes`` are columns in falling order of ``variance``; ``live`` says along which there is any."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    live: np.ndarray
    total: float

    def apply(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows that remain, their exact squared deviations, their whitened values), in parts."""
        unit = np.sqrt(np.where(self.live, self.variance, 1.0))
        for row, x in integers(column, self.dim):
            dev = deviations(x, self.n, self.sums)
            white = dev.astype(float) / self.n @ self.axes / unit
            white[:, ~self.live] = np.nan
            yield row, squares(dev), white


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening | None:
    """The leading components of all remaining vectors, or None if there is none."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    found = rows.mapInArrow(lengths, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return None
    dim, n = found
    exact = rows.mapInArrow(lambda b: partial_sums(b, dim), "pos long, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s"))
    sums = [int(r.s) for r in exact.orderBy("pos").collect()]  # one number a dimension
    level = durable(rows.mapInArrow(lambda b: _factors(b, dim, n, sums), FACTOR))
    while level.count() > FAN:  # partitions next to each other meet, and a sixteenth is left
        old, level = level, durable(level.withColumn("g", F.floor(F.col("k") / FAN)).groupBy("g").applyInArrow(lambda t: _merge(t, dim), FACTOR))
        discard(old)
    last = unpacked(level.orderBy("k").toArrow(), dim)
    discard(level)
    r = triangle(np.concatenate(last))
    _, s, vt = np.linalg.svd(r)
    s = np.append(s, np.zeros(dim - len(s)))
    most = min(components, dim)
    axes = vt[:most].T.copy()
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(most)] < 0, -1.0, 1.0)
    live = s[:most] > s[0] * max(dim, 8) * EPS * 64 if s[0] > 0 else np.zeros(most, bool)
    return Whitening(dim, n, sums, axes, s[:most] ** 2 / n, live, float((s**2).sum() / n))


def _products(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """A partition's sums of products of whitened values, whose means are zero as the deviations' sums are."""
    total = np.zeros((len(model.live),) * 2)
    for batch in batches:
        for _, _, white in model.apply(batch.column(0)):
            white = np.nan_to_num(white)
            total += white.T @ white
    yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(total.size)), "s": pa.array(total.ravel())})


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    sums = rows.mapInArrow(lambda b: _products(b, model), "pos long, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect()  # components x components
    size = len(model.live)
    got = np.zeros(size * size)
    for r in sums:
        got[r.pos] = r.s
    off = np.abs(got.reshape(size, size) / model.n - np.eye(size))[np.ix_(model.live, model.live)]
    return float(off.max()) if off.size else None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each remaining vector: id, ``deviation`` (decimal, null beyond 38 digits) and ``whitened``, an array; with the constants ``n``, ``explained`` (an array) and ``identity_error``."""
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = dict(narrow.dtypes)["id"]
    model = fit(vectors, vector_col, components)
    if model is None:
        return narrow.where("false").select(F.col("id").alias(id_col), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    error = identity_error(vectors, model, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, square, white in model.apply(batch.column(1)):
                values = pa.array(white.ravel(), from_pandas=True)  # NaN is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * white.shape[1]), values)
                exact = pa.array([Decimal(int(v)) if v < 10**38 else None for v in square.tolist()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), exact, lists], ["id", "deviation", "whitened"])

    explained = [float(v / model.total) if model.total else None for v in np.where(model.live, model.variance, 0.0)]
    out = narrow.mapInArrow(run, f"id {id_type}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)
    return out.select("*", F.lit(model.n).cast("long").alias("n"), F.array(*(F.lit(v).cast("double") for v in explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def component_rows(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1; ``deviation`` is null where a long does not hold it."""
    each = white.select(id_col, "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"), F.col("explained").alias("e"), "identity_error")
    return each.select(id_col, (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("e", F.col("k")).alias("explained"), "identity_error")
