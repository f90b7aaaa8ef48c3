"""The register of queries: a function of (spark, sf_dir), and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", ctes: str = "") -> Callable[[Query], Query]:
    """Register under the function's name. The SQL may use the named views and further common table expressions."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [p for p in (duck(*views.split()) if views else "", ctes) if p]
            recursive = "RECURSIVE " if "RECURSIVE" in ctes or "UNION ALL SELECT /*r*/" in ctes else ""
            ORACLES[f.__name__] = (f"WITH {recursive}" + ",\n".join(parts).replace("RECURSIVE ", "") + "\n" if parts else "") + sql
        return f

    return put
