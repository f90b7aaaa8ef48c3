"""Line de-duplication across documents.

Normalised lines are exploded and hashed, documents are counted per hash, and
the lines whose hash reaches the threshold are dropped; the rest is put
together again by position. The counts combine on the map side, so a line that
every document has costs one row a task.

Up to ``BROADCAST_LINES`` frequent hashes are sent to every task, which drops the
lines where the texts lie: no text crosses the network. Beyond that the frequent
hashes are joined to those of the lines, gathered by text (equal texts lose equal
lines, whatever their ids), and joined to the texts. Both ways give the same rows.

Defined cases: a row is a document, so repeated rows count each; a null or
empty text is one empty line, whose key is too short to be dropped by default;
a null text stays null in ``dedup_lines`` if nothing is dropped from it; rows
with a null id, or one repeated id, keep their places and do not meet in one task; a text of any
length is split whole; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import durable

STRIP = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = STRIP.encode()
#: Frequent hashes of 16 bytes that are sent to every task.
BROADCAST_LINES = 1 << 20
SEED = 42  # of Spark's xxhash64
#: Tables of a worker by the token of their broadcast.
_hot: dict[str, dict[int, set[int]]] = {}


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits, so that unequal lines do not meet at any size of corpus."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """The hash of each line's key, null for keys below min_chars."""
    return F.transform(F.transform(_lines(text), line_key), lambda k: F.when(F.length(k) >= min_chars, key_hash(k)))


def frequent(docs: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes of the lines that enough documents have."""
    own = docs.select(F.explode(F.array_distinct(_hashes(F.col(text_col), min_chars))).alias("h")).where("h is not null")
    return durable(own.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h.a", "h.b"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def second_seed() -> int:
    """The seed of the second hash: that of the integer 1."""
    return xxhash.xxh64_intdigest((1).to_bytes(4, "little"), SEED)


def kept_lines(text: bytes, hot: dict[int, set[int]], min_chars: int) -> tuple[int, int, bytes]:
    """(lines before, lines after, what stays)."""
    lines = text.split(b"\n")
    if not hot:
        return len(lines), len(lines), text
    out, seed = [], second_seed()
    for line in lines:
        key = line.strip(BLANK).lower()  # of bytes: A-Z only
        second = hot.get(signed(xxhash.xxh64_intdigest(key, SEED)))
        if second is None or signed(xxhash.xxh64_intdigest(key, seed)) not in second or len(key.decode("utf-8", "replace")) < min_chars:
            out.append(line)
    return len(lines), len(out), b"\n".join(out) if len(out) < len(lines) else text


def _lookup(shared) -> dict[int, set[int]]:
    token, pairs = shared.value
    if token not in _hot:
        _hot.clear()
        table = _hot[token] = {}
        for a, b in pairs.tolist():
            table.setdefault(a, set()).add(b)
    return _hot[token]


def _in_place(batches: Iterator[pa.RecordBatch], shared, text_col: str, min_chars: int, report: bool) -> Iterator[pa.RecordBatch]:
    hot = _lookup(shared)
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = part.column(at).cast(pa.large_binary()).to_pylist()
            done = [kept_lines(t or b"", hot, min_chars) for t in texts]
            others = {c: part.column(k) for k, c in enumerate(part.schema.names)}
            if report:
                others.pop(text_col)
                before, after, kept = zip(*done)
                others |= {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array([b - a for b, a in zip(before, after)], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
            else:
                others[text_col] = pa.array([None if t is None and b == a else k for (b, a, k), t in zip(done, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(others)


def joined(docs: DataFrame, hot: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """``docs`` with the arrays of its lines and of those that stay, by joins on hashes of whole texts."""
    print_ = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), text_col).alias("b"))
    own = docs.select(print_.alias("__ld_print"), F.explode(F.array_distinct(_hashes(F.col(text_col), min_chars))).alias("h")).where("h is not null").distinct()
    hits = own.join(hot.select(F.struct("a", "b").alias("h")), "h").groupBy("__ld_print").agg(F.map_from_entries(F.collect_set(F.struct("h", F.lit(True)))).alias("__ld_hot"))
    lines = docs.withColumn("__ld_print", print_).join(hits, "__ld_print", "left").drop("__ld_print").withColumn("__ld_lines", _lines(F.col(text_col)))
    stays = F.filter("__ld_lines", lambda x: (F.length(line_key(x)) < min_chars) | ~F.map_contains_key(F.col("__ld_hot"), key_hash(line_key(x))))
    return lines.withColumn("__ld_kept", F.when(F.col("__ld_hot").isNull(), F.col("__ld_lines")).otherwise(stays)).drop("__ld_hot")


def _small(hot: DataFrame, most: int):
    """A broadcast of the frequent hashes, or None if there are more."""
    if hot.count() > most:
        return None
    pairs = np.array([(r.a, r.b) for r in hot.collect()], np.int64).reshape(-1, 2)
    return hot.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pairs))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the text of what stays, and the same columns."""
    hot = frequent(docs, text_col, min_docs, min_chars)
    shared = _small(hot, most)
    if shared is not None:
        return docs.mapInArrow(lambda b: _in_place(b, shared, text_col, min_chars, False), docs.schema)
    marked = joined(docs, hot, text_col, min_chars)
    same = F.size("__ld_kept") == F.size("__ld_lines")
    return marked.withColumn(text_col, F.when(same, F.col(text_col)).otherwise(F.array_join("__ld_kept", "\n"))).select(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most: int = BROADCAST_LINES) -> DataFrame:
    """Per document: its id, lines before, lines dropped and the SHA-256 of what stays."""
    narrow = docs.select(id_col, text_col)
    hot = frequent(narrow, text_col, min_docs, min_chars)
    shared = _small(hot, most)
    if shared is not None:
        return narrow.mapInArrow(lambda b: _in_place(b, shared, text_col, min_chars, True), f"`{id_col}` {dict(narrow.dtypes)[id_col]}, n_lines long, n_dropped long, kept_sha256 string")
    marked = joined(narrow, hot, text_col, min_chars)
    size = lambda c: F.size(c).cast("long")
    return marked.select(id_col, size("__ld_lines").alias("n_lines"), (size("__ld_lines") - size("__ld_kept")).alias("n_dropped"), F.sha2(F.array_join("__ld_kept", "\n"), 256).alias("kept_sha256"))


#: The same in DuckDB.
SQL = r"""
WITH l AS (SELECT doc_id, rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
           FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents)),
k AS (SELECT doc_id, rid, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY rid, doc_id
"""
