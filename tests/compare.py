"""Runs registered queries in Spark and DuckDB and compares the rows."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def connect(data=DATA):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "~"
        return repr(round(float(v), 8) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    for c in df.columns:
        df[c] = [text(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, con, query, sql, data=DATA):
    got, want = normal(query(spark, str(data)).toPandas()), normal(con.execute(sql).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)
