"""Operators on small tables: brute-force doubles, and nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontam, extract, langid, line_dedup, mixing, near_dup, quality, suffix_dedup, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocab=VOCAB):
    words = [rng.choice(vocab) + (rng.choice(VOCAB) if rng.random() < 0.5 else "") for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words).strip()


def odd_rows():
    """Null, empty, blank, repeated and very long texts, null ids and null columns."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, same, "en", "b", 1), (4, same, "en", "b", 1), (5, same, None, None, None), (None, same, "en", "a", 1), (6, long, "de", "a", 9), (7, long + " end", "de", "a", 9), (8, "one", "en", "c", 3),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 3, 30, 120, 300])) for _ in range(60)]
    base, passage = texts[4], prose(rng, 40)
    for k in range(40):
        words = re.split(r"( |\n)", rng.choice(texts[:8] + [base] * 4))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words) // 2 + 1) * 2] = rng.choice(VOCAB)
        texts.append("".join(words))
    texts += [texts[k % 20] + "\n" + passage + "\n" + prose(rng, 20) for k in range(15)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def clash(df, *names):
    """Extra columns whose names an operator might use itself."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("x"))
    return df


NAMES = ["id", "text2", "n", "h", "v", "key", "size", "part", "done", "batch", "line", "seed", "rep", "fp", "src", "rate", "w", "p", "shape", "host", "html2", "copies2"]


# quality


def slow_quality(text):
    words = WORD.findall(text or "")
    out = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")]
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    out.append(len(lines) - len(set(lines)))
    cover = lambda n, later: sorted({i + k for i in range(len(words) - n + 1) for k in range(n) if later(n, i)})
    grams = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = {n: {} for n in (5, 7, 10)}
    firsts = {n: {} for n in (5, 7, 10)}
    for n in counts:
        for i, g in enumerate(grams(n)):
            counts[n][g] = counts[n].get(g, 0) + 1
            firsts[n].setdefault(g, i)
    out.append(len(cover(5, lambda n, i: counts[n][tuple(words[i : i + n])] > 1)))
    out += [sum(len(words[k]) for k in cover(n, lambda n, i: firsts[n][tuple(words[i : i + n])] < i)) for n in (5, 7, 10)]
    seen, chars = set(), 0
    for x in lines:
        chars += sum(map(len, WORD.findall(x))) if x in seen else 0
        seen.add(x)
    return [*out, chars]


def test_quality_equals_brute_force(spark, corpus):
    rows = corpus + [(900, "a b c d e " * 6), (901, "#| x\n#| x\n\n#| x"), (902, "é ü ñ\u00a0x é ü ñ y é ü ñ"), (903, "same line here\n" * 5)]
    got = {r[0]: list(r[1:10]) for r in quality.quality_report(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == slow_quality(t), t[:80]


def test_quality_of_odd_rows(spark, odd):
    report = {(r.doc_id): r for r in quality.quality_report(odd).collect()}
    assert report[1].n_words == 0 and report[1].base_failed and not report[2].kept and report[6].kept
    kept = quality.filter_quality(clash(odd, *NAMES, "kept", "base_failed"))
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 4, 4, 5, 6, 7]
    assert quality.quality_report(odd.limit(0)).count() == 0


# line dedup


def slow_lines(rows, min_docs):
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs = {}
    for r, (_, t) in enumerate(rows):
        for x in {key(s) for s in (t or "").split("\n")}:
            docs[x] = docs.get(x, 0) + 1
    hot = {k for k, n in docs.items() if n >= min_docs and k}
    return [(i, len((t or "").split("\n")), [s for s in (t or "").split("\n") if key(s) not in hot]) for i, t in rows]


def test_line_dedup_equals_brute_force(spark, corpus):
    rows = corpus + [(500 + k, f"Top  \n Menu\t\nown {k}\n\n MENU") for k in range(6)] + [(600, "menu\x0b"), (601, "")]
    for least in (2, 3, 6):
        got = sorted(tuple(r) for r in line_dedup.line_report(frame(spark, rows), min_docs=least).collect())
        want = sorted((i, n, n - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()) for i, n, left in slow_lines(rows, least))
        assert got == want


def test_line_dedup_of_odd_rows(spark, odd):
    docs = clash(odd, *NAMES)
    out = line_dedup.dedup_lines(docs, min_docs=4)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[4] == "" and text[8] == "one" and text[None] == ""
    assert line_dedup.line_report(odd.limit(0)).count() == 0


def test_line_dedup_by_joins_equals_that_in_place(spark, corpus, odd):
    rows = corpus + [(500 + k, f"Top  \n Menu\t\nown {k}\n\n MENU") for k in range(6)]
    for docs, chars in ((frame(spark, rows), 1), (clash(odd, *NAMES), 1), (frame(spark, rows), 5), (odd, 0)):
        one, other = (sorted(map(tuple, line_dedup.line_report(docs, min_docs=3, min_chars=chars, most=most).collect()), key=str) for most in (1 << 20, 0))
        assert one == other and any(r[2] for r in one)
        one, other = (sorted(map(tuple, line_dedup.dedup_lines(docs, min_docs=3, min_chars=chars, most=most).collect()), key=str) for most in (1 << 20, 0))
        assert one == other


def bulk(spark, n=100_000):
    """A hundred thousand rows with a null id, as many with one id, half of the latter equal."""
    kind = F.when(F.col("id") < n, None).otherwise(7).cast("long")
    text = F.concat_ws("\n", F.lit("common line"), F.when(F.col("id") < n + n // 2, F.concat(F.lit("text "), F.col("id") % 1000)).otherwise("the same"), F.lit("die und der"))
    return spark.range(2 * n).repartition(16).select(kind.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))


def largest_group(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_null_and_repeated_ids_in_bulk(spark):
    """No group and no collect holds the rows of a null or repeated id together."""
    docs = bulk(spark)
    texts = langid.sample_labelled(docs, "text", "lang", "doc_id", 64, 40_000)
    assert set(texts) == {"en"} and len(texts["en"]) <= 64 * 40 and texts == langid.sample_labelled(docs.repartition(3), "text", "lang", "doc_id", 64, 40_000)
    placed = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.monotonically_increasing_id().alias("place"), F.lit(6).cast("long").alias("size"))
    groups = 200_000 // mixing.GROUP
    assert largest_group(mixing.dealt(placed), F.pmod(F.xxhash64("key", F.lit(5)), F.lit(groups))) < 1.2 * mixing.GROUP
    report = mixing.mix_report(docs)
    assert report.count() == 200_000 and abs(report.agg(F.sum("taken")).first()[0] - report.first().target) <= 7
    lines = line_dedup.line_report(docs)
    assert lines.count() == 200_000 and lines.agg(F.sum("n_dropped")).first()[0] == 600_000
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    typed = warc.with_record_types(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert largest_group(typed, F.spark_partition_id()) < 50_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_held_out_is_never_null(spark, tmp_path):
    from inkwell.llm.queries import op1_language_id

    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op1_language_id(spark, str(tmp_path)).where("held_out is null").count() == 0


# near duplicates


def slow_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: (len(s), least[find(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("shingle, percent", [(2, 80), (5, 80), (2, 90)])
def test_near_dup_equals_brute_force(spark, corpus, shingle, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(frame(spark, corpus), shingle=shingle, percent=percent).collect()}
    assert got == slow_components(corpus, shingle, percent)


def test_near_dup_of_a_large_group(spark):
    """More copies of one text than a short list holds, each with a few words changed."""
    rng = random.Random(2)
    base = prose(rng, 200).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dup.components(frame(spark, rows), shingle=2).collect()}
    assert got == {i: c for i, (_, c) in slow_components(rows, 2, 80).items()}


def test_near_dup_of_sets_around_the_sketch_size(spark):
    """Pairs of similarity 0.80 or a little more of which only one side has more shingles than a sketch."""
    rows = []
    for d, n in enumerate([80, 79, 76, 72] * 10):
        words = [f"w{d}x{k}" for k in range(n + 4)]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[:68]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(frame(spark, rows)).collect()}
    assert got == slow_components(rows, 5, 80) and all(c == d - d % 2 for d, (_, c) in got.items())


def bits(rows):
    """Texts of one of two words at each place."""
    return [(d, " ".join(f"{'b' if x else 'a'}{k}" for k, x in enumerate(row))) for d, row in enumerate(rows)]


def test_near_dup_holds_outsiders_of_any_number_against_a_component(spark, monkeypatch):
    """Outsiders that only members far from every leader resemble, in blocks of a few documents and without a bound on the comparisons."""
    monkeypatch.setattr(near_dup, "RESIDUAL_PAIRS", 0, raising=False)
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    inner = rng.permuted(np.arange(100) < 10 + np.zeros((350, 1)), axis=1)
    outer = inner[:150].copy()
    for row in outer:
        row[rng.choice(np.flatnonzero(~row), 9, replace=False)] = True
    rows = bits([*inner, *outer, np.zeros(100, bool)])
    got = {r.doc_id: r.component_id for r in near_dup.components(frame(spark, rows), shingle=1).collect()}
    assert got == {i: c for i, (_, c) in slow_components(rows, 1, 80).items()}


def test_near_dup_links_in_long_lists_without_a_main_component(spark):
    """Pairs that share no value with fewer than a hundred other documents."""
    rng = np.random.default_rng(5)
    first = rng.random((150, 100)) < 0.5
    second = first.copy()
    for row in second:
        row[rng.choice(100, 8, replace=False)] ^= True
    rows = bits([*first, *second])
    got = {r.doc_id: r.component_id for r in near_dup.components(frame(spark, rows), shingle=1).collect()}
    assert got == {i: c for i, (_, c) in slow_components(rows, 1, 80).items()} and len(set(got.values())) == 150


def test_near_dup_of_odd_rows(spark, odd):
    found = near_dup.components(clash(odd, *NAMES), shingle=2)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in found.collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True) and got[8, 1] == (8, True)
    assert [v for (i, _), v in got.items() if i == 5] == [(4, False)] and [v for (i, _), v in got.items() if i == 7] == [(6, False)] and [v for (i, _), v in got.items() if i is None] == [(None, True)]
    kept = near_dup.dedup_documents(clash(odd, *NAMES), shingle=2)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4", "6", "8", "None"]
    assert near_dup.components(odd.limit(0)).count() == 0


# substrings


def slow_removal(rows):
    first = {}
    texts = {}
    for i, t in rows:
        b = (t or "").encode()
        texts.setdefault(i, []).append(b)
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(spark, corpus):
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(frame(spark, corpus)).collect())
    assert got == slow_removal(corpus)


@pytest.mark.parametrize("hot_count, batch_bytes", [(1, 2000), (1, 1 << 24), (40, 2000), (1 << 16, 500)])
def test_hot_anchors_take_suffix_arrays_of_their_windows(spark, corpus, hot_count, batch_bytes):
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(frame(spark, corpus), hot_count=hot_count, batch_bytes=batch_bytes).collect())
    assert got == slow_removal(corpus)


@pytest.mark.parametrize("hot_count", [100, 1 << 16])
def test_a_line_in_many_batches(spark, hot_count):
    """One line, repeated within and over more than 512 batches, between words that differ."""
    rng = random.Random(6)
    line = prose(rng, 30).replace("\n", " ")
    rows = [(i, "\n".join([f"own{rng.randrange(10**9)}", line, line if i % 3 else line[10:], f"x{i}", line])) for i in range(700)]
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(frame(spark, rows), hot_count=hot_count, batch_bytes=100).collect())
    assert got == slow_removal(rows)


def test_anchors_are_the_same_in_any_steps():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offs = np.array([0, 0, 30, 80, 1000, 1049, 3000, 5000])
    pos, h = suffix_dedup.anchors(data, offs)
    for step in (1, 7, 60, 997):
        p, g = suffix_dedup.anchors(data, offs, step)
        assert p.tolist() == pos.tolist() and g.tolist() == h.tolist()
    begins = rng.random(5000) < 0.01
    want = np.zeros(5000, bool)
    for k in np.flatnonzero(begins):
        want[k : k + 50] = True
    for step in (1, 49, 50, 51, 700, 10_000):
        assert (suffix_dedup.covered(begins, step) == want).all()


def test_contexts_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "column_hash", lambda columns, seed=0: np.zeros(len(columns), np.uint64))
    rng = np.random.default_rng(9)
    spots = np.zeros(40, suffix_dedup.SPOT)
    spots["ctx"], spots["id"], spots["hi"] = rng.integers(0, 2, (40, 1)), rng.integers(0, 9, 40), 27
    first, number = suffix_dedup.distinct(spots)
    assert (spots[first][number]["ctx"] == spots["ctx"]).all() and len(first) == 2
    assert all(spots["id"][f] == spots["id"][number == k].min() for k, f in enumerate(first))


def test_units_of_a_shard_are_merged():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, suffix_dedup.CONTEXT, dtype=np.uint8)
    spots = np.zeros(60, suffix_dedup.SPOT)
    for k in range(60):
        c = base.copy()
        c[rng.integers(0, 26, 3)] = rng.integers(97, 101, 3)
        c[rng.integers(52, 76, 3)] = rng.integers(97, 101, 3)
        spots[k]["ctx"], spots[k]["id"], spots[k]["hi"] = c, rng.integers(0, 30), suffix_dedup.SPREAD
    want = []
    windows = [[bytes(s["ctx"][o : o + 50]) for o in range(suffix_dedup.SPREAD)] for s in spots]
    least = {}
    for s, ws in zip(spots, windows):
        for w in ws:
            least[w] = min(least.get(w, 99), int(s["id"]))
    want = [sum(1 << o for o, w in enumerate(ws) if least[w] < s["id"]) for s, ws in zip(spots, windows)]
    for unit in (7, 20, 100):
        assert suffix_dedup.repeated_windows(spots, unit).tolist() == want
    assert suffix_dedup.mark_contexts(spots).tolist() == want


def test_common_prefixes_are_exact():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, (40, suffix_dedup.CONTEXT), dtype=np.uint8)
    text[20:] = text[:20]
    order, _ = suffix_dedup.suffix_array(text)
    lcp = suffix_dedup.common_prefixes(text, order)
    suffix = lambda f: bytes(text[f // suffix_dedup.SPREAD, f % suffix_dedup.SPREAD :][:50])
    assert all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:]))
    for a, b in zip(order, order[1:]):
        n = next((k for k in range(50) if suffix(a)[k] != suffix(b)[k]), 50)
        assert lcp[b // suffix_dedup.SPREAD, b % suffix_dedup.SPREAD] == n


def test_substrings_of_odd_rows(spark, odd):
    rows = suffix_dedup.removal_report(clash(odd, *NAMES)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert len(rows) == 10 and got[1] == [(0, 0)] and got[2] == [(0, 0)] and got[8] == [(3, 0)]
    assert len(got[4]) == 2 and all(n == 0 for _, n in got[4]) and all(a == b for a, b in got[5]) and all(n == 0 for _, n in got[None])
    long = odd_rows()[7][1]
    assert got[7] == [(len(long) + 4, len(long))]
    assert suffix_dedup.removal_report(odd.limit(0)).count() == 0


def test_links_of_blocks_equal_brute_force(monkeypatch):
    """Outsiders against a block: every other label that has a similar set is linked, once, whatever the sizes of the parts."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    for owned in (1 << 22, 100, 1):
        monkeypatch.setattr(near_dup, "OWNED", owned)
        pool = [np.unique(rng.integers(-(2**62), 2**62, n)) for n in (5, 30, 70, 150, 400)]
        rows = []
        for k in range(120):
            base = pool[k % 5]
            kept = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15, 0.3])]
            own = np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, int(rng.choice([0, 1, len(base) // 10])))]))
            if len(own):
                rows.append({"id": k, "label": int(rng.integers(0, 12)), "n": len(own), "need": 1, "sketch": np.sort(own)[: near_dup.SKETCH].tolist(), "hashes": np.sort(own).astype("<i8").tobytes()})
        kind = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("need", pa.int32()), ("sketch", pa.list_(pa.int64())), ("hashes", pa.binary())])
        table = pa.Table.from_pylist(rows, kind)
        outside, block = table.slice(0, 50), table.slice(50)
        got = [tuple(r.values()) for r in near_dup._links(outside, block, 80).to_pylist()]
        label, sets = {r["id"]: r["label"] for r in rows}, {r["id"]: set(np.frombuffer(r["hashes"], "<i8").tolist()) for r in rows}
        alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        want = {(a["id"], b["label"]) for a in rows[:50] for b in rows[50:] if a["label"] != b["label"] and alike(a["id"], b["id"])}
        assert all(alike(a, b) for a, b in got) and len(got) == len({(a, label[b]) for a, b in got}) and {(a, label[b]) for a, b in got} == want and len(want) > 20


# decontamination


def slow_overlaps(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in rows:
        a = words(t)
        for i, s in items:
            b = words(s)
            if not b:
                continue
            w = min(13, len(b))
            need = 11 if w == 13 else w - 1 if w >= 10 else w
            where = {}
            for j, x in enumerate(b):
                where.setdefault(x, []).append(j)
            diagonals = {}
            for p, x in enumerate(a):
                for j in where.get(x, ()):
                    diagonals.setdefault(p - j, set()).add(j)
            for hit in diagonals.values():  # of each diagonal, the places where words agree
                if len(hit) >= need:
                    best = max(sum(k + r in hit for r in range(w)) for k in range(len(b) - w + 1))
                    if best >= need:
                        out[d, i] = max(out.get((d, i), 0), best)
    return out


def contaminated(rng):
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 9, 10, 11, 12, 13, 14, 20, 40, 1, 2])] + [(20, None), (21, "")]
    rows = []
    for d in range(80):
        parts = [prose(rng, rng.choice([5, 40]))]
        if d % 2:
            w = WORD.findall(rng.choice(items[:9])[1])
            for _ in range(d % 5):
                w[rng.randrange(len(w))] = "changed"
            parts.append(" ".join(w[rng.choice([0, 0, 2]) :]))
        rows.append((d, " ".join(parts + [prose(rng, 10)])))
    return rows, items


@pytest.mark.parametrize("seeds", [decontam.BROADCAST_SEEDS, 0])
def test_decontamination_equals_brute_force(spark, seeds):
    """With seeds broadcast, and in shuffled joins."""
    rows, items = contaminated(random.Random(9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.overlaps(frame(spark, rows), bench, broadcast_seeds=seeds).collect()}
    assert got == slow_overlaps(rows, items) and len(got) > 10


def test_items_of_one_length_only(spark):
    """Masks of lengths that no item has are not looked for; short items match where they stand whole."""
    rows = [(1, "a b c d"), (2, "b c"), (3, "c b"), (4, "c"), (5, "")]
    for item, want in (("b c", [1, 2]), ("c", [1, 2, 3, 4]), ("a b c d e", [])):
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        assert sorted(r.doc_id for r in decontam.overlaps(frame(spark, rows), bench).collect()) == want


@pytest.mark.parametrize("seeds", [decontam.BROADCAST_SEEDS, 0])
def test_an_item_of_ten_thousand_words(spark, seeds):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(10_000)]
    cut = lambda a, n, *bad: " ".join("other" if k in bad else w for k, w in enumerate(words[a : a + n]))
    rows = [(1, cut(0, 13)), (2, "before " + cut(9_987, 13, 2, 7)), (3, cut(5000, 13, 1, 5, 9)), (4, cut(127, 14, 0) + " after"), (5, cut(4000, 10)), (6, " ".join(words))]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.n_matched for r in decontam.overlaps(frame(spark, rows), bench, broadcast_seeds=seeds).collect()}
    assert got == {1: 13, 2: 11, 4: 13, 6: 13}


def test_masks_find_any_two_substitutions():
    import itertools

    for bad in itertools.combinations(range(13), 2):
        assert any(all(s + o not in bad for o, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(13 - len(m) + 1))


def test_items_of_ten_words_match_with_any_word_replaced(spark):
    item = prose(random.Random(3), 10, [f"{a}{b}" for a in VOCAB for b in VOCAB])
    rows = []
    for d in range(10):
        w = item.split()
        w[d] = "changed"
        rows.append((d, " ".join(["before", *w, "after"])))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.overlaps(frame(spark, rows), bench).collect()}
    assert got == slow_overlaps(rows, [(1, item)]) and len(got) == 10


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, odd_rows()[3][1]), (2, None), (1, odd_rows()[3][1])], "item_id long, text string")
    docs = clash(odd, *NAMES)
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.overlaps(docs, bench).collect()) == [("4", 1), ("5", 1), ("None", 1)]
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 6, 7, 8]
    assert decontam.overlaps(odd, bench.limit(0)).count() == 0 and decontam.overlaps(odd.limit(0), bench).count() == 0


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 1000], [5, 2], 1515, 2) == [20.0, 1495.0]
    assert mixing.targets([0, 10], [5, 2], 15, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 0, 2) == []


def test_pivot_keeps_the_words():
    rng = np.random.default_rng(1)
    size, part = rng.integers(1, 500, 200), rng.random(200)
    x, left = mixing.pivot(size, part, rng.random(200))
    assert math.isclose((size * x).sum(), (size * part).sum(), rel_tol=1e-9)
    assert all(v in (0, 1) for k, v in enumerate(x) if k != left)


def test_pivot_is_fair():
    size, part = np.array([3, 5, 2, 7]), np.array([0.3, 0.6, 0.5, 0.2])
    rng = np.random.default_rng(2)
    total = np.zeros(4)
    for _ in range(4000):
        x, left = mixing.pivot(size, part, rng.random(4))
        total += x
    assert np.allclose(total / 4000, part, atol=0.03)


def test_mix_meets_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 80)), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_report(docs, group=16).collect()
    again = mixing.mix_report(docs.repartition(5), group=16).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 900
    source = {r[0]: r[3] for r in rows}
    taken, target, largest = {}, {}, {}
    for r in out:
        s = source[r.doc_id]
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
        target[s], largest[s] = r.target, max(largest.get(s, 0), r.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def slow_targets(sizes):
    """Targets by their definition, in fractions: the largest common level of weight that the capped sources leave."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        left = Fraction(150 * sum(sizes.values()), 100) - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {s: Fraction(2 * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def test_mix_query_equals_brute_force(spark, tmp_path):
    from inkwell.llm.queries import op4_mixing

    rng = random.Random(14)
    rows = [(k, prose(rng, rng.randrange(1, 60)), rng.choice(["b", "a", "a", "Z", "é", None])) for k in range(400)] + [(900, None, "a"), (901, " \n", "only blanks"), (902, "one", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_mixing(spark, str(tmp_path)).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    target = slow_targets(total)
    taken = {}
    for i, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and math.isclose(r.target, float(target[s]), rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, _, x in rows if x == s)
    assert len(got) == len(rows)


def test_mix_documents_takes_what_its_report_says(spark):
    """Rows with a null id and repeated rows keep their copies; those of one source add up to its target."""
    rng = random.Random(15)
    rows = [(None if k % 3 else k % 7, prose(rng, rng.randrange(5, 40)), "en", f"s{k % 2}", k) for k in range(200)]
    rows += rows[:20]
    out = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {k: len(WORD.findall(t)) for _, t, _, _, k in rows}
    total = {s: sum(len(WORD.findall(r[1])) for r in rows if r[3] == s) for s in ("s0", "s1")}
    for s, want in slow_targets(total).items():
        words = sum(size[r.n_chars] * r.copies for r in out if r.source == s)
        assert abs(words - want) <= max(size.values())


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix_report(clash(odd, *NAMES)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    docs = clash(odd, *NAMES)
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "copies"] and all(r.copies > 0 for r in out.collect())
    assert mixing.mix_report(odd.limit(0)).count() == 0 and mixing.mix_documents(odd.limit(0)).count() == 0


# language


def slow_phrases(text, train):
    n, at, size = 0, 0, len(text)
    while at < size:
        end = at + 1
        while end < size and text[at : end + 1] in train:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(3)
    texts = {"aa": "".join(rng.choice("ab c") for _ in range(300)), "bb": "".join(rng.choice("bcd ") for _ in range(200))}
    model = langid.Automata({k: langid.fold(v) for k, v in texts.items()})
    asked = [langid.fold("".join(rng.choice("abcd e") for _ in range(n))) for n in (1, 5, 40, 120)]
    bounds = np.cumsum([0, *map(len, asked)])
    symbols = model.symbol[[ord(c) for c in "".join(asked)]].astype(np.int64)
    got = model.phrases(symbols, bounds)
    for row, train in zip(got, texts.values()):
        assert row.tolist() == [slow_phrases(t, langid.fold(train)) for t in asked]


def slow_language(rows):
    """The query by its definition: train on all labelled rows that are not held out, in the order of the ids' hashes, and cut each text's pieces into longest matches."""
    import zlib

    import xxhash

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    key = lambda i: (lambda v: v - 2**64 if v >= 2**63 else v)(xxhash.xxh64(str(i).encode(), seed=42).intdigest())
    train = {}
    for i, text, lang in sorted(rows, key=lambda r: (r[2] or "", key(r[0]))):
        if not held[i] and lang is not None and text:
            train[lang] = (train.get(lang, "") + " " + langid.fold(text)).strip()
    letters = set("".join(train.values()))
    out = {}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = (held[i], "und", 0.0)
            continue
        folded = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text))
        pieces = [folded[k : k + langid.PIECE] for k in range(0, len(folded), langid.PIECE)]
        cost = {}
        for lang in sorted(train):
            n = 0
            for p in pieces:
                at = 0
                while at < len(p):
                    end = at + 1
                    while p[at] in letters and end < len(p) and p[at : end + 1] in train[lang]:
                        end += 1
                    n, at = n + 1, end
            cost[lang] = n * math.log2(max(len(train[lang]), 2))
        first, second = sorted(cost.values())[:2]
        out[i] = (held[i], min(cost, key=lambda k: (cost[k], k)), round(second / (first + second), 9))
    return out


def test_language_query_equals_brute_force(spark, tmp_path):
    from inkwell.llm.queries import op1_language_id

    rng = random.Random(8)
    vocab = {"aa": "der die das und nicht über größe".split(), "bb": "the of and not over size".split(), "cc": "le la et pas été où sur".split()}
    rows = [(k, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "en", ". ", "\n", "7"]) for _ in range(rng.choice([1, 5, 60, 500]))), lang if k % 4 else None) for k, lang in enumerate(rng.choice(list(vocab)) for _ in range(40))]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 .", "bb"), (903, "日本 the", None), (904, "ΔΕΖ" * 300, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in op1_language_id(spark, str(tmp_path)).collect()}
    assert got == slow_language(rows) and max(len(t or "") for _, t, _ in rows) > 3 * langid.PIECE


@pytest.mark.parametrize("dense_bytes", [0, 1 << 30])
def test_automata_of_a_large_alphabet(dense_bytes):
    """Letters beyond the alphabet's bound end a phrase; the others' phrases stay exact."""
    rng = random.Random(13)
    letters = [chr(0x4E00 + k) for k in range(400)]
    texts = {k: "".join(rng.choice(letters[:300] if k == "x" else letters[100:]) for _ in range(3000)) for k in "xy"}
    model = langid.Automata(texts, dense_bytes)
    assert model.width == langid.MAX_ALPHABET + 2
    known = {c for c in letters if model.symbol[ord(c)]}
    asked = [texts["x"][50:90], texts["y"][10:40] + texts["x"][5:9]]
    symbols = model.symbol[[ord(c) for c in "".join(asked)]].astype(np.int64)
    got = model.phrases(symbols, np.cumsum([0, *map(len, asked)]))
    for row, train in zip(got, texts.values()):
        cut = lambda t: re.sub("[^" + "".join(known) + "]", "\0", t)
        assert row.tolist() == [slow_phrases(re.sub("\0", "\1", cut(t)), cut(train)) for t in asked]


def test_held_out_accuracy(spark):
    from inkwell.llm.queries import op1_language_id

    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = op1_language_id(spark, d).where("held_out").join(truth, "doc_id").where("lang is not null")
    assert held.count() > 100 and held.where("lang = lang_pred").count() / held.count() > 0.97


def test_language_of_odd_rows(spark, odd):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(clash(odd, *NAMES), odd).collect()}
    assert got[1] == ("und", 0) and got[2] == ("und", 0) and got[3] == ("und", 0) and got[6][0] == "de" and 0 <= got[6][1] <= 1
    assert {r.lang_pred for r in langid.predict_language(odd, odd.limit(0)).collect()} == {"und"}
    assert langid.predict_language(odd.limit(0), odd).count() == 0


# pages

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    big, other = "<p>é</p>" * 200, "<p>x</p>" * 200
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", other), (None, "u", other), (9, "u", big), (7, "u", "")]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(clash(spark.createDataFrame(rows, PAGES), *NAMES)).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        leader = {big: 9, other: 6}.get(h)
        revisit = leader is not None and i is not None and i < leader
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    assert got == sorted(want)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_of_bounded_size(spark, tmp_path):
    """Pages that fill many archives of 1 MB come back whole; a damaged record or frame becomes a row with an error."""
    rng = np.random.default_rng(2)
    rows = [(k, f"http://h/{k}", "<p>" + bytes(rng.integers(97, 123, 150_000, dtype=np.uint8)).decode()) for k in range(40)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    path = f"{tmp_path}/warc"
    warc.write_archives(warc.with_record_types(pages), path, warc.sample_dictionary(pages), archive_bytes=1 << 20)
    files = sorted(tmp_path.glob("warc/part-*"))
    assert len(files) >= 4 and max(f.stat().st_size for f in files) < (1 << 20) + 100_000
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert got == {k: h for k, _, h in rows}
    bad = files[0].read_bytes()
    for f in tmp_path.glob("warc/.*.crc"):
        f.unlink()
    files[0].write_bytes(bad[: len(bad) // 2])
    rest = warc.read_archives(spark, path)
    assert rest.where("error is not null").count() == 1 and 30 < rest.where("error is null").count() < 40
    raw = warc.encode_record(1, "u", b"text", "response", None)
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    data = warc.dict_frame(b"") + pack(raw) + pack(raw.replace(b"WARC/1.1", b"WARC/9.9")) + pack(raw)
    assert [r.get("page_id") for r in warc.scan_archive(data)] == [1, None, 1]


def test_archives_are_read_in_linear_time():
    """Four times the records take no more than some four times as long."""
    import time

    import zstandard

    pack = zstandard.ZstdCompressor().compress
    took = {}
    for n in (8_000, 32_000):
        data = warc.dict_frame(b"") + b"".join(pack(warc.encode_record(k, f"http://h/{k}", str(k).encode() * 100, "response", None)) for k in range(n))
        start = time.perf_counter()
        assert sum(1 for _ in warc.read_archive(data)) == n
        took[n] = time.perf_counter() - start
    assert took[32_000] < 8 * took[8_000] and took[8_000] < 5


def test_frames_of_every_form():
    """Raw, repeated and compressed blocks, with and without size and checksum, end where their headers say."""
    import zstandard

    rng = np.random.default_rng(3)
    for block in (b"", b"a" * 1_000_000, bytes(rng.integers(0, 256, 300_000, dtype=np.uint8)), b"text of a page " * 40_000):
        for size in (True, False):
            for check in (True, False):
                frame = zstandard.ZstdCompressor(write_content_size=size, write_checksum=check).compress(block)
                assert warc.frame_end(frame + b"next", 0) == len(frame)
                for cut in {1, 3, len(frame) // 2, len(frame) - 1}:
                    with pytest.raises((warc.BadRecord, IndexError)):
                        warc.frame_end(frame[:cut], 0)


def test_payloads_survive_and_damage_is_found():
    import zstandard

    samples = [f"<html><body>{k} text of a page that repeats</body></html>".encode() * 3 for k in range(200)]
    d = warc.train_dictionary(samples)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    raw = [warc.encode_record(k, f"http://h/{k}", s, "response", None) for k, s in enumerate(samples[:5])]
    data = warc.dict_frame(d) + b"".join(c.compress(r) + warc.SEPARATOR.encode() for r in raw)
    assert d and [r["payload"] for r in warc.read_archive(data)] == samples[:5]
    packed = warc.dict_frame(zstandard.compress(d)) + data[len(warc.dict_frame(d)) :]
    assert len(list(warc.read_archive(packed))) == 5
    for bad in (data[:-20], data + b"junkjunk", data[: len(warc.dict_frame(d))] + warc.dict_frame(d) + data[len(warc.dict_frame(d)) :]):
        with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
            list(warc.read_archive(bad))
    for change in ((b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"repeats", b"repeat5"), (b"WARC-Type", b"X-Type")):
        with pytest.raises(warc.BadRecord):
            warc.decode_record(raw[0].replace(*change))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("just   words &amp; more", "just words & more"), ("<script>x</script><style>p{}</style>", ""),
        ("<body><nav><a href=/>Home</a></nav><article><h1>Title &eacute;</h1><p>One\n two<br>three <b>bold</b>.<p>Next &#x26; last.</article><footer>foot</footer>", "Title é\nOne two three bold.\nNext & last."),
        ("<div class='cookie-notice'>We use cookies</div><article><p>Body text.</p><aside>Side</aside><form>Mail <input></form></article><div id=comments><p>Nice post, really a long comment by a reader.</p></div>", "Body text."),
        ("<article><p>Cut &lt;off", "Cut <off"), ("<main><ul><li>First item<li>Second item</ul></main>", "First item\nSecond item"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def test_main_text_without_article_element():
    links = "".join(f"<li><a href=/{k}>link number {k}</a></li>" for k in range(20))
    body = "".join(f"<p>Paragraph {k} of the story has a good many words, so that it reads as text.</p>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Story</h1><div>{body}</div></div><div>{links}</div></body>"
    want = ["Story", *(f"Paragraph {k} of the story has a good many words, so that it reads as text." for k in range(6))]
    assert extract.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Before.</p><p><a href=/a>One link</a></p><ul><li><a href=/1>First source</a><li><a href=/2>Second source</a></ul><h2><a href=/h>Linked heading</a></h2>", "Before.\nOne link\nFirst source\nSecond source\nLinked heading"),
        *((f"<p>Before.</p><h2 id={i}>Title</h2><section id='{i}'><p>Part.</p></section>", "Before.\nTitle\nPart.") for i in ("discussion", "related-work", "legal", "reviews", "search")),
        ("<p>Before.</p><div class='side-by-side'><p>Left.</p><p>Right.</p></div>", "Before.\nLeft.\nRight."),
        ("<p>Before.</p><section id=comments><p>Nice.</p></section><section id='related-posts'><p>More.</p></section><div class='sidebar'><p>Side.</p></div>", "Before."),
    ],
)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_main_text_keeps_links_and_sections_of_an_article(html, text, tag):
    assert extract.main_text(f"<{tag}>{html}</{tag}>") == text


def test_extraction_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    from html import unescape

    for r in extract.extract_text(clash(pages, *NAMES)).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    assert extract.extract_text(pages.limit(0)).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def test_url_rules_equal_brute_force(spark):
    urls = [
        "http://www.Example.com/en/1", "https://a.example.com/en/x?q#f", "https://example.com/en", "http://b.com/", "http://b.com", "http://notexample.com/en/2", "http://x.net/es/9", "http://x.net/es", "ftp://net/es/1#/a", "http://net?x=/es/", "nonsense", "://h/p", None, "http://a://b/c", "HTTP://COM/é",
    ]
    rows = list(enumerate(urls))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(clash(spark.createDataFrame(rows, "page_id long, url string"), *NAMES), RULES).collect()}
    for i, u in rows:
        _, found, rest = (u or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if found else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i][:3] == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert got[i][3] == max(fit)[2]


def test_merged_branches_decide(spark):
    """Smoothed purity allows and rejects after a merge at a deeper node; a sibling that differs stays apart and out of the pool."""
    rows, rules = [], []

    def add(branch, good, bad, open_=1):
        for k in range(good + bad + open_):
            n = len(rows)
            verdict = "allow" if k < good else "block" if k < good + bad else None
            rows.append((n, f"http://site.org/top/{branch}/p{n:05d}/{'own' if verdict is None else verdict}"))
            if verdict:
                rules.append(("site.org", f"/top/{branch}/p{n:05d}/", verdict))

    add("a", 40, 20)  # allowed by itself
    add("b", 1, 2)  # rejected by itself (2 of 5), within chance of a: merged, allowed
    add("c", 0, 30)  # differs: rejected, and its labels do not count for a and b
    add("d", 0, 0)  # without labels: judged by all its siblings, 41 of 93
    rows = [(n, u.replace("/own", "/own").replace("/allow", "/own").replace("/block", "/own")) for n, u in rows]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    found = {r.template.split("/")[2]: (r.verdict, round(r.purity, 6)) for r in got}
    assert found == {"a": ("allow", round(42 / 65, 6)), "b": ("allow", round(42 / 65, 6)), "c": ("block", round(1 / 32, 6)), "d": ("block", round(42 / 95, 6))}


def test_branches_without_labels(spark):
    """They borrow from the deepest family that has labels, then from their host, and pass nothing on; on a host without labels they are allowed."""
    rules = [("a.net", "/es/", "block"), ("a.net", "/fr/", "block"), ("b.net", "/x/", "allow")]
    urls = ["http://a.net/es/p", "http://a.net/fr/p", "http://a.net/de/p", "http://a.net/de/q/r", "http://a.net", "http://b.net/x/1", "http://b.net/y/z/1", "http://c.net/es/p"]
    rows = [(k, u) for k, u in enumerate(urls * 3)]
    got = {r.page_id: (r.rule, r.verdict, round(r.purity, 4)) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert [got[k] for k in range(8)] == [("a.net/es/", "block", 0.125), ("a.net/fr/", "block", 0.125), (None, "block", 0.125), (None, "block", 0.125), (None, "block", 0.125), ("b.net/x/", "allow", 0.8), (None, "allow", 0.8), (None, "allow", 0.5)]


def test_verdicts_of_both_kinds_without_a_rule(spark):
    from inkwell.llm.queries import op9_url_filter

    rows = op9_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_rules_of_equal_length_and_long_urls(spark):
    """Of equally long rules that fit, the last in the list decides; a url of a megabyte is split whole."""
    rules = [("site.org", "/", "allow"), ("site.org", "/", "block"), ("e.org", "/ab", "block"), ("ite.org", "/", "allow")]
    long = "http://long.org/" + "/".join(f"s{k}" for k in range(200_000))
    rows = [(1, "http://site.org/x"), (2, "http://e.org/abc"), (3, long), (4, "http://long.org/" + "9" * 1_000_000)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (got[1].verdict, got[2].verdict) == ("block", "block") and got[3].path == long[15:] and len(got[4].path) == 1_000_001 and got[4].template == "/*"


def test_url_templates(spark):
    """A branch that the rules blocked wherever they could tell is rejected where they can't; others stay."""
    rules = [("site.org", "/bad/1", "block"), ("site.org", "/good/1", "allow")]
    rows = [(k, f"http://site.org/{'bad' if k % 2 else 'good'}/{1 + k % 3}{k:04d}/{k}") for k in range(120)] + [(999, "http://other.org/bad/2/2")]
    rows += [(1000 + k, f"http://big.org/user{k}x/photo") for k in range(30)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k in range(120)) and got[999].verdict == "allow"
    assert {got[1000 + k].template for k in range(30)} == {"/*/photo"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, rules).count() == 0
