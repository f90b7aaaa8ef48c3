"""The stored page index as a data source: partitions by ranges of pages, of which a read opens those that it asks for.

``write_pages`` lays an index out in folders that name their ranges (``first=0/last=4095``),
so that a reader knows from the listing which folders hold the pages asked for; the others are
neither listed further nor opened. Within a file, Parquet's own statistics do the rest.

    read_pages(spark, path, first=100, last=200)
    spark.read.format("inkwell_pages").option("first", 100).option("last", 200).load(path)

Pages are asked for by options and not by pushed filters: Spark 4.1 keeps the filters that a
Python source took for the table and not for the scan, so that two filters on one table would
both read the pages of the later one. Filters on other columns, and on the page, are Spark's.
Paths may be of any kind that pyarrow reads (local, HDFS, S3, GCS, as URIs).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import STORED_PAGE

RANGE = re.compile(r"first=(-?\d+)/last=(-?\d+)(?:/|$)")
#: Pages of a folder.
PAGES_PER_RANGE = 4096


def write_pages(index: DataFrame, path: str, pages_per_range: int = PAGES_PER_RANGE) -> None:
    """Write rows of STORED_PAGE in folders of page ranges; one shuffle brings each range together."""
    first = F.floor(F.col("page") / pages_per_range) * pages_per_range
    ranged = index.withColumns({"first": first, "last": first + pages_per_range - 1})
    ranged.repartition("first").sortWithinPartitions("first", "page").write.partitionBy("first", "last").parquet(path)


@dataclass
class PageRange(InputPartition):
    """The files of one folder."""

    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


@dataclass
class StoredPagesReader(DataSourceReader):
    path: str
    columns: list[str]
    low: int | None = None
    high: int | None = None
    pages: set[int] | None = field(default=None)

    def touches(self, first: int, last: int) -> bool:
        if self.low is not None and last < self.low or self.high is not None and first > self.high:
            return False
        return self.pages is None or any(first <= p <= last for p in self.pages)

    def partitions(self) -> list[PageRange]:
        """One for each folder that may hold pages asked for."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)
        out = []
        for top in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if top.type != pyarrow.fs.FileType.Directory or not top.base_name.startswith("first="):
                continue
            for folder in fs.get_file_info(pyarrow.fs.FileSelector(top.path)):
                m = RANGE.search(folder.path)
                if m and self.touches(int(m[1]), int(m[2])):
                    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet")]
                    if files:
                        out.append(PageRange(sorted(files)))
        return sorted(out, key=lambda p: p.files[0])

    def expression(self) -> pc.Expression | None:
        page = pc.field("page")
        parts = [page >= self.low] if self.low is not None else []
        parts += [page <= self.high] if self.high is not None else []
        parts += [page.isin(sorted(self.pages))] if self.pages is not None else []
        whole = None
        for p in parts:
            whole = p if whole is None else whole & p
        return whole

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        fs = pyarrow.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pyarrow.fs.LocalFileSystem()
        for f in partition.files if partition is not None else []:
            table = pq.read_table(f, filesystem=fs, columns=self.columns, filters=self.expression(), partitioning=None)
            yield from table.to_batches(max_chunksize=64)


class StoredPages(DataSource):
    """A folder of ``write_pages``."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_pages"

    def schema(self) -> str:
        return STORED_PAGE

    def reader(self, schema) -> StoredPagesReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("name the folder of the pages: load(path)")
        number = lambda name: int(self.options[name]) if self.options.get(name) not in (None, "") else None
        pages = {int(p) for p in self.options["pages"].split(",") if p.strip()} if "pages" in self.options else None
        return StoredPagesReader(path, list(schema.names), number("first"), number("last"), pages)


def read_pages(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, pages: Iterable[int] | None = None) -> DataFrame:
    """The stored pages from ``first`` to ``last``, and of the list ``pages``, where given."""
    spark.dataSource.register(StoredPages)
    reader = spark.read.format(StoredPages.name())
    for name, value in (("first", first), ("last", last), ("pages", None if pages is None else ",".join(map(str, sorted(set(pages)))))):
        reader = reader if value is None else reader.option(name, str(value))
    return reader.load(path)
