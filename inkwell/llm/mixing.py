"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source starts with the same number of copies, target /
source size. The whole part is taken; of the fractional parts two documents at
a time meet, and words move at random from one to the other, in such
proportion that their sum stays, until one of the two has a whole number of
copies. What is left of a group is one document with a fraction; these meet in
groups again, level by level, until a source has one left, which is rounded at
random. So each source's words differ from its target by less than one
document.

Groups hold ``GROUP`` documents of one source, dealt by a hash of id, source and size,
so a source with a third of all rows is spread over tasks like any other. Of what more
than ``ALIKE`` rows share (a null id, an id that repeats) each row is dealt by its
place in the table. Coins come from the same hashes: reruns over the same files agree,
and where ids tell rows apart, those over any files.

Defined cases: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in the order; repeated rows and rows with a null id are
rounded one by one; texts of any length count whole; an empty table gives an
empty result; extra columns are ignored by ``mix_report``
and kept by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import durable, text_blocks
from ._text import Words

GROUP = 2048
#: Rows of one id, source and size that are dealt together.
ALIKE = 64
WEIGHTS = (5, 2, 1)


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; no share exceeds ``most`` times its size, and the excess goes to the others by weight."""
    share, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                share[i] = left * weights[i] / w
            break
        for i in full:
            share[i] = float(most * sizes[i])
            open_.discard(i)
        left = max(0.0, total - sum(share[i] for i in range(len(sizes)) if i not in open_))
    return share


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in text_blocks(batch.column(2)):
            n = Words(data, offs, hashed=False).counts()
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1, 3)), pa.array(n.astype(np.int64))], ["id", "src", "place", "size"])


def pivot(size: np.ndarray, part: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` (in (0, 1)) with sum(size * part) kept. Returns the rounded fractions and the index of the one left over, or -1."""
    x = part.astype(float).copy()
    left = -1
    for i in range(len(x)):
        if not 1e-12 < x[i] < 1 - 1e-12:
            x[i] = round(x[i])
            continue
        if left < 0:
            left = i
            continue
        a, b = size[left], size[i]
        up = min((1 - x[left]) * a, x[i] * b)  # words that can move to the waiting one, and from it
        down = min(x[left] * a, (1 - x[i]) * b)
        move = up if coin[i] * (up + down) < down else -down
        x[left] += move / a
        x[i] -= move / b
        for k in (left, i):
            if x[k] < 1e-9 or x[k] > 1 - 1e-9:
                x[k] = round(x[k])
        open_ = [k for k in (left, i) if 0 < x[k] < 1]
        left = open_[0] if open_ else -1
    return x, left


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "id", "size"], kind="stable").reset_index(drop=True)
    coin = ((pdf["key"].to_numpy().astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(float) / 2**53
    x, left = pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(), coin)
    pdf["part"] = x
    pdf["done"] = np.arange(len(pdf)) != left
    return pdf


def _round_last(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _round_group(pdf)
    coin = ((pdf["key"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2**53
    pdf["part"] = np.where(pdf["done"], pdf["part"], (coin < pdf["part"]).astype(float))
    pdf["done"] = True
    return pdf


def dealt(sized: DataFrame) -> DataFrame:
    """Rows (id, src, place, size) with the ``key`` that deals them to groups and draws their coins."""
    keyed = sized.withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit(11), "src", "size"))
    alike = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ALIKE).select("key", F.lit(True).alias("alike")))
    return keyed.join(alike, "key", "left").withColumn("key", F.when(F.col("alike"), F.xxhash64("key", "place")).otherwise(F.col("key"))).drop("alike")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document: its id, ``size``, its source's ``source_size`` and ``target``, and the words ``taken``. The options are those of ``taken_words``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).alias("text"))
    return taken_words(narrow, **options).withColumnRenamed("id", id_col)


def taken_words(narrow: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, group: int = GROUP) -> DataFrame:
    """The report for rows (id, src, text)."""
    spark = narrow.sparkSession
    id_type = dict(narrow.dtypes)["id"]
    placed = narrow.select("id", "src", "text", F.monotonically_increasing_id().alias("place"))
    sized = durable(placed.mapInArrow(_sizes, f"id {id_type}, src string, place long, size long"))
    # one row a source; the mixture is a stated list of sources, and its shares are settled on the driver
    totals = sorted(((r.src, r.size, r.n) for r in sized.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()), key=lambda t: (t[0] is None, t[0] or ""))
    share = targets([t[1] for t in totals], [weights[i % len(weights)] for i in range(len(totals))], percent * sum(t[1] for t in totals) / 100, most)
    table = spark.createDataFrame(
        [(s, size, t, t / size if size else 0.0, max(1, -(-n // group))) for (s, size, n), t in zip(totals, share)], "src2 string, source_size long, target double, rate double, groups int"
    )
    rows = (
        dealt(sized).drop("place")
        .join(table, F.col("src").eqNullSafe(F.col("src2")))
        .drop("src2")
        .withColumns({"whole": F.floor("rate").cast("long"), "part": F.col("rate") - F.floor("rate")})
    )
    schema = "id " + id_type + ", src string, size long, source_size long, target double, whole long, part double, key long, groups int, g int, done boolean"
    plain = (F.col("size") == 0) | (F.col("part") == 0)
    level = rows.where(~plain).select("id", "src", "size", "source_size", "target", "whole", "part", "key", "groups", F.pmod(F.xxhash64("key", F.lit(5)), F.col("groups")).cast("int").alias("g"), F.lit(False).alias("done"))
    out = [rows.where(plain).select("id", "size", "source_size", "target", "whole", F.lit(0.0).alias("part"))]
    most_groups = max((max(1, -(-n // group)) for _, _, n in totals), default=1)
    while True:
        last = most_groups == 1
        rounded = durable(level.groupBy("src", "g").applyInPandas(_round_last if last else _round_group, schema))
        out.append(rounded.where("done").select("id", "size", "source_size", "target", "whole", "part"))
        if last:
            break
        most_groups = -(-most_groups // group)
        level = rounded.where("not done").withColumn("g", F.floor(F.col("g") / group).cast("int"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("id", "size", "source_size", "target", ((F.col("whole") + F.col("part").cast("long")) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every document that the mix takes, with all columns and the number of ``copies``; rows of one id, source and text share its copies in no fixed order.

    Rows are told apart by a hash of all three, so that rows with a null id, or with one repeated id, do not meet in one task.
    """
    name = F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(F.col(id_col).cast("string"), F.col(source_col).cast("string"), text_col)))
    taken = taken_words(docs.select(name.alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).alias("text")), **options)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("long")).otherwise(0)
    lists = taken.groupBy(F.col("id").alias("__mx_key")).agg(F.sort_array(F.collect_list(copies), False).alias("__mx_copies"))  # as many as there are equal rows
    both = docs.withColumn("__mx_key", name).join(lists, "__mx_key")
    nth = F.row_number().over(Window.partitionBy("__mx_key").orderBy("__mx_key"))
    both = both.withColumn("__mx_n", nth).withColumn("copies", F.get("__mx_copies", F.col("__mx_n") - 1))
    return both.where("copies > 0").select(*docs.columns, "copies")
