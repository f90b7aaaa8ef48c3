"""The Merkle manifest against a plain double, its SQL, and odd tables."""

import hashlib
import random
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from inkwell.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    each = []
    for c in merkle.FIELDS:
        v = row[c]
        each.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return digest(*each)


def tree(nodes):
    """(root, for each node its list of (left, right))."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for p, i in zip(proofs, at):
            run = runs[i // 3]
            p.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at, nodes = [i // 3 for i in at], [digest(*run) for run in runs]
    return nodes[0], proofs


def double(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    inner = {s: tree([leaf(r) for r in by_source[s]]) for s in names}
    root, outer = tree([inner[s][0] for s in names])
    out = []
    for s, o in zip(names, outer):
        for r, p in zip(by_source[s], inner[s][1]):
            seen = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                seen["text"] = r["text"].replace("\n", "")
            node = leaf(seen)
            for left, right in p + o:
                node = digest(left, node, right)
            out.append((r["doc_id"], leaf(r), inner[s][0], root, digest(*(a + b for a, b in p + o)), node, node == root))
    return sorted(out, key=str)


def found(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit(7))
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def make(n, sources, seed=3):
    rng = random.Random(seed)
    return [
        {"doc_id": i * 7 - 50, "text": "".join(rng.choice("ab\n é") for _ in range(rng.randrange(20))), "lang": rng.choice(["en", None, ""]), "source": rng.choice(sources), "n_chars": rng.choice([None, 0, -3, 12])}
        for i in range(n)
    ]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, ["a"]), (3, ["a", None]), (300, ["a", "b", "", None, "é", "z" * 70]), (40, [f"s{i}" for i in range(40)]), (5, ["a", "b", "c", "d", "e"])])
def test_manifest_equals_double(spark, tmp_path, n, sources):
    rows = make(n, sources)
    assert found(spark, rows, tmp_path) == double(rows)


def test_more_rounds_and_levels_than_one(spark):
    """Blocks of nine nodes, so that sources of different sizes take different numbers of rounds; one holds most rows."""
    assert [merkle.block_levels(n, 2) for n in (1, 2, 3, 4, 9, 900)] == [0, 1, 1, 2, 2, 2]
    nodes = merkle.numbered(spark.createDataFrame([("=a", i, digest(str(i))) for i in range(100)], "grp string, o long, h string"), ["o"])
    rounds = merkle.climb(nodes, 2)
    assert [r.count() for r in rounds] == [100, 12, 2, 1]
    assert rounds[-1].first().h == tree([digest(str(i)) for i in range(100)])[0]
    rows = make(260, ["hot"] * 8 + [f"s{i}" for i in range(12)] + [None], 9)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    got = merkle.manifest(df, levels=2).withColumn("proof", merkle.siblings(F.col("proof")))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, digest(r.proof)) for r in got.collect()), key=str) == [r[:5] for r in double(rows)]


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, null and empty texts, a long text, extra columns, clashing names."""
    rows = make(60, ["a", "b"], 5)
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[4], text=None), dict(rows[4], text=""), dict(rows[5], doc_id=None), dict(rows[5], doc_id=None), dict(rows[6], doc_id=None, text="\n\n"), dict(rows[7], text="line\n" * 400_000)]
    assert found(spark, rows, tmp_path, ["grp", "pos", "h", "n", "leaf", "root", "proof", "__part"]) == double(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_equal_rows_and_null_ids_in_bulk(spark):
    """No partition gets all of 20,000 equal rows or of 20,000 null ids."""
    df = spark.range(40_000).select(F.when(F.col("id") < 20_000, 5).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    leaves = df.select(F.col("doc_id").alias("o"), F.lit("=s").alias("grp"), merkle.leaf_of(*(F.col(c) for c in merkle.FIELDS)).alias("h"))
    placed = merkle.numbered(leaves, ["o", "h"])
    assert placed.select("pos").distinct().count() == 40_000 and placed.agg(F.max("pos"), F.max("n")).first()[:] == (39_999, 40_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be put together
    try:
        assert merkle.laid_out(leaves, ["o", "h"]).groupBy("__part").count().agg(F.max("count")).first()[0] < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_sql(spark):
    compare.same(spark, compare.connect(), queries.op12_merkle_manifest, merkle.SQL)


def test_tampering_is_found(spark):
    rows = merkle.manifest(spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(30)], SCHEMA), carry={"seen": merkle.leaf_of(*(F.when(F.col("doc_id") == 3, "other").otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS))})
    assert {r.doc_id for r in merkle.verified(rows).where("not verified").collect()} == {3}
