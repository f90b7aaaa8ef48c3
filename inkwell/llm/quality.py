"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths measure the characters that lie
inside n-grams found earlier in the same text, and inside lines found earlier.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows are judged one by one and get the same result; a text of any
length is judged whole, its bytes read step by step; an empty table gives an
empty result; extra columns are kept by ``filter_quality`` and ignored by
``quality_report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._io import text_blocks
from ._text import Words, covered, repeated, sampled_sums

#: (words in an n-gram, most percent of word characters in n-grams found earlier).
NGRAM_LIMITS = ((5, 15), (7, 13), (10, 10))
#: Most percent of word characters in lines found earlier.
LINE_LIMIT = 20
#: Least words, and most percent of words in repeated 5-word windows.
MIN_WORDS, REPEAT_LIMIT = 10, 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup{n}_chars" for n, _ in NGRAM_LIMITS), "dup_line_chars")


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of REPORT for each text of a block."""
    w = Words(data, offs)
    lead = lambda first, last: (data[first:last] & 0xC0) != 0x80
    chars = (sampled_sums(lead, len(data), w.end) - sampled_sums(lead, len(data), w.start)).astype(np.int32)
    marks = sampled_sums(lambda first, last: SYMBOL[data[first:last]], len(data), offs)
    out = {"n_words": w.counts(), "word_chars": w.per_doc(chars), "n_symbols": np.diff(marks)}
    salt = np.random.default_rng(7).integers(0, 1 << 63, w.n_docs, dtype=np.int64).astype(np.uint64)
    n_words = len(w.start)
    for n, _ in NGRAM_LIMITS:
        first, key = w.shingles(n)
        key ^= salt[0] if w.n_docs == 1 else salt[w.doc[first]]
        found, earlier = repeated(key)
        if n == 5:
            out["n_repeat_words"] = w.per_doc(covered(first[found], n, n_words))
        out[f"dup{n}_chars"] = w.per_doc(np.where(covered(first[earlier], n, n_words), chars, 0))
        del first, key, found, earlier
    begin = np.union1d(offs[:-1][np.diff(offs) > 0], np.flatnonzero(data == 10) + 1)
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offs, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), offs[doc + 1])
    end = np.where((end > begin) & (data[end - 1] == 10), end - 1, end)
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    full = b > a
    begin, end, doc, a, b = begin[full], end[full], doc[full], a[full], b[full]

    _, earlier = repeated(w.hashes(begin, end) ^ salt[doc])
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    out["n_dup_lines"] = np.bincount(doc[earlier], minlength=w.n_docs)
    out["dup_line_chars"] = np.bincount(doc[earlier], weights=(total[b] - total[a])[earlier], minlength=w.n_docs).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base rules failed, kept), in integers."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_LIMIT * m["n_words"])
    bad = 100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for n, most in NGRAM_LIMITS:
        bad |= 100 * m[f"dup{n}_chars"] > most * m["word_chars"]
    return failed, ~failed & ~bad


def _tables(batches: Iterator[pa.RecordBatch], text_col: str, keep_all: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        for i, j, data, offs in text_blocks(batch.column(at)):
            m = measure(data, offs)
            failed, kept = verdict(m)
            rows = batch.slice(i, j - i)
            if keep_all:
                cols = [rows.column(k) for k in range(rows.num_columns) if k != at]
                names = [x for k, x in enumerate(rows.schema.names) if k != at]
                cols += [pa.array(m[k].astype(np.int64)) for k in REPORT] + [pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, [*names, *REPORT, "base_failed", "kept"])
            else:
                yield rows.filter(pa.array(kept))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts of REPORT, ``base_failed`` and ``kept``."""
    narrow = docs.select(id_col, text_col)
    schema = f"`{id_col}` {dict(narrow.dtypes)[id_col]}, " + ", ".join(f"{k} long" for k in REPORT) + ", base_failed boolean, kept boolean"
    return narrow.mapInArrow(lambda batches: _tables(batches, text_col, True), schema)


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    return docs.mapInArrow(lambda batches: _tables(batches, text_col, False), docs.schema)


def _gram_sql(n: int) -> str:
    """Words of n-grams found earlier (and, for the base rules, anywhere else) in the same text."""
    flags = f"""g{n} AS (SELECT rid, p, chars, g IS NOT NULL AND row_number() OVER (PARTITION BY rid, g ORDER BY p) > 1 AS later, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS found FROM (
  SELECT rid, p, chars, CASE WHEN count(*) OVER w = {n} THEN string_agg(word, ' ') OVER w END AS g FROM w WINDOW w AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)))"""
    cover = f"""c{n} AS (SELECT rid, CAST(sum(CASE WHEN later THEN chars ELSE 0 END) AS BIGINT) AS dup, CAST(count(*) FILTER (WHERE found) AS BIGINT) AS rep FROM (
  SELECT rid, chars, max(later) OVER w AS later, max(found) OVER w AS found FROM g{n} WINDOW w AS (PARTITION BY rid ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY rid)"""
    return f"{flags},\n{cover}"


#: The report in DuckDB.
SQL = (
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, word, length(word) AS chars, i AS p FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d))),
"""
    + ",\n".join(_gram_sql(n) for n, _ in NGRAM_LIMITS)
    + r""",
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT rid, CAST(count(*) FILTER (WHERE dup) AS BIGINT) AS n_dup_lines, CAST(coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE dup), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY rid),
t AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars FROM w GROUP BY rid),
r AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c5.rep, 0) AS n_repeat_words,
  coalesce(c5.dup, 0) AS dup5_chars, coalesce(c7.dup, 0) AS dup7_chars, coalesce(c10.dup, 0) AS dup10_chars, coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM d LEFT JOIN t USING (rid) LEFT JOIN n USING (rid) LEFT JOIN c5 USING (rid) LEFT JOIN c7 USING (rid) LEFT JOIN c10 USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND """
    + " AND ".join([f"100 * dup{n}_chars <= {most} * word_chars" for n, most in NGRAM_LIMITS] + [f"100 * dup_line_chars <= {LINE_LIMIT} * word_chars"])
    + " AS kept FROM b"
)
