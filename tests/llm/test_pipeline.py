"""The queries against their SQL, and the pipeline's stages against brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from inkwell.llm import queries  # noqa: E402

import test_small as small  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare.same(spark, compare.connect(), queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, str(compare.DATA)).count() > 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    d = str(compare.DATA)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in rows.items()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            limits = small.quality.NGRAM_LIMITS
            for i, t in list(left.items()):
                m = small.slow_quality(t)
                bad = m[0] < 10 or 100 * m[4] > 20 * m[0] or 100 * m[8] > 20 * m[1] or any(100 * m[5 + j] > most * m[1] for j, (_, most) in enumerate(limits))
                if bad:
                    del left[i]
        elif name == "line_dedup":
            left = {i: "\n".join(lines) for i, _, lines in small.slow_lines(sorted(left.items()), 10)}
        elif name == "near_dup":
            found = small.slow_components(sorted(left.items()), 5, 80)
            left = {i: t for i, t in left.items() if found[i][1] == i}
        elif name == "decontaminate":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            gone = {i for i, _ in small.slow_overlaps(sorted(left.items()), bench)}
            left = {i: t for i, t in left.items() if i not in gone}
        if name != "mix":
            assert got == left, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert set(got) <= set(left) and docs.columns == [*columns, "copies"]
    size = {i: len(small.WORD.findall(t)) for i, t in left.items()}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    total = {}
    for i in left:
        total[source[i]] = total.get(source[i], 0) + size[i]
    copies = {r.doc_id: r.copies for r in docs.collect()}
    for s, words in small.slow_targets(total).items():
        taken = sum(size[i] * n for i, n in copies.items() if source[i] == s)
        assert abs(taken - words) <= max(size[i] for i in left if source[i] == s)
    assert max(copies.values()) <= 2
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(got)


def test_stages_take_odd_rows(spark):
    """Which rows each stage keeps of nulls, empties, repeats, copies and very long texts, with extra columns of clashing names."""
    rows = small.odd_rows()
    docs = small.clash(spark.createDataFrame(rows, small.SCHEMA), *small.NAMES, "kept", "u", "label", "main", "num", "hashes")
    every = sorted((str(r[0]), r[1] or "") for r in rows)
    some = lambda *ids: sorted((str(r[0]), r[1] or "") for r in rows if r[0] in ids)
    want = {"quality_rules": some(None, 4, 5, 6, 7), "line_dedup": every, "near_dup": some(None, 1, 2, 3, 4, 6, 8), "decontaminate": every}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(compare.DATA))
        assert out.columns == docs.columns + (["copies"] if name == "mix" else [])
        got = out.collect()
        if name != "mix":
            assert sorted((str(r.doc_id), r.text or "") for r in got) == want[name], name
            assert all(r.text is None for r in got if r.doc_id == 1)
        assert stage(spark, docs.limit(0), str(compare.DATA)).count() == 0
    size = lambda text: len(small.WORD.findall(text or ""))
    total, largest = {}, {}
    for _, text, _, source, _ in rows:
        total[source] = total.get(source, 0) + size(text)
        largest[source] = max(largest.get(source, 0), size(text))
    for source, words in small.slow_targets(total).items():
        assert abs(sum(size(r.text) * r.copies for r in got if r.source == source) - words) <= largest[source]
    assert all(1 <= r.copies <= 2 and size(r.text) for r in got)
