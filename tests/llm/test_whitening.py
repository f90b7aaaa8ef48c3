"""Whitening against the eigenvectors of the covariance, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def double(ids, vectors, most=32):
    """{(id, component): (deviation, whitened, explained)} by the plain way, and n."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    n = len(x)
    centred = x - x.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    return dev, centred @ v / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(centred.T @ centred / n), n


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v], 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n, dim, parts", [(200, 6, 1), (700, 40, 50), (90, 33, 3)])
def test_whitening_equals_eigenvectors(spark, n, dim, parts):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, dim)) * np.linspace(3, 0.5, dim) + rng.normal(size=dim)).astype(np.float32)
    df = frame(spark, list(enumerate(vectors))).repartition(parts)
    rows = whitening.component_rows(whitening.whiten(df)).toPandas()
    dev, white, explained, _ = double(range(n), vectors)
    most = min(dim, 32)
    assert len(rows) == n * most and set(rows.component) == set(range(1, most + 1)) and (rows.n == n).all()
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for k in range(most):  # either sign, the same for all rows
        assert min(np.abs(got[:, k] - s * white[:, k]).max() for s in (1, -1)) < 1e-7
    assert rows.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[range(n)].tolist() == dev
    assert np.allclose(rows.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-6)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-8
    cov = np.cov(got.T, bias=True)
    assert np.abs(cov - np.eye(most)).max() < 1e-8


def test_far_from_the_origin(spark):
    """Entries of 10^9 with spreads of one: centring is exact, so nothing is lost."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-100, 100, size=(300, 5)) + 2.0**30
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    rows = whitening.component_rows(whitening.whiten(df)).toPandas()
    x = vectors - 2.0**30
    e = np.linalg.eigvalsh(np.cov((64 * x).T, bias=True))[::-1]
    assert np.allclose(rows.drop_duplicates("component").sort_values("component").explained, e / e.sum(), rtol=1e-9) and rows.identity_error.iloc[0] < 1e-9


def test_odd_rows(spark):
    """Null, NaN, infinite, short and empty vectors go; repeated rows and null ids stay; extra columns with clashing names are ignored."""
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4)) for i in range(30)]
    rows = good + [good[0], (None, rng.normal(size=4))] + [(100, None), (101, [1, None, 2, 3]), (102, [1, float("nan"), 2, 3]), (103, [1, 2, float("inf"), 3]), (104, [1, 2, 3]), (105, []), (106, [-float("inf")] * 4)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("n", "v", "id", "deviation", "whitened", "k", "e")})
    got = whitening.component_rows(whitening.whiten(df)).toPandas()
    assert len(got) == 32 * 4 and (got.n == 32).all()
    assert set(got.vec_id.dropna()) == set(range(30)) and got.vec_id.isna().sum() == 4 and (got.vec_id == 0).sum() == 8
    assert got.identity_error.iloc[0] < 1e-9


def test_without_variance(spark):
    one = whitening.component_rows(whitening.whiten(frame(spark, [(1, [1, 2, 3])]))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    flat = whitening.component_rows(whitening.whiten(frame(spark, [(i, [i, 5, 2 * i]) for i in range(10)]))).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all()
    assert flat[flat.component == 1].explained.iloc[0] == pytest.approx(1) and flat.identity_error.iloc[0] < 1e-9
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_exact_beyond_64_bits():
    x = np.array([[2**61, -(2**61)], [3, 4]], np.int64)
    sums = [int(2**61) + 3, 4 - int(2**61)]
    dev = whitening.deviations(x, 2, sums)
    assert whitening.squares(dev).tolist() == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def test_many_factors_and_a_common_vector(spark):
    """More factors than one task merges, and a vector that a third of the rows share."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[200:400] = vectors[0]
    df = frame(spark, list(enumerate(vectors))).repartition(3 * whitening.FAN)
    rows = whitening.component_rows(whitening.whiten(df)).toPandas()
    _, _, explained, _ = double(range(600), vectors)
    assert np.allclose(rows.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)


def test_query_on_the_table(spark):
    rows = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == 500 * 32 and rows.identity_error.iloc[0] < 1e-9
