"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is
the ``SKETCH`` smallest of them. Equal sets are one class, and only the class's
smallest document goes on. The inverted lists of the retained values generate
overlaps: of each sketch the rarest values are enough, as two sketches of
similar sets share at least ``LEAST_SHARED`` values (below that with a chance of
about 1e-6 at a similarity of 0.8), so that the values that most documents have
build no list. Lists of up to ``SMALL_LIST`` documents give all their pairs; in
longer ones, of which the ``LISTS`` shortest count, every document meets leaders,
the ones with the most common sketch of each of ``LEADERS`` slices.

Each document's best candidates come first: pairs pass the union-sketch estimate
and are then verified exactly, on full sets, which are made from the texts of
the documents that some pair asks for. Of the other candidates only those
between different components can change the result; they go the same way. Last,
documents of a long list that are still in different components are held
against each other, block by block: sketch overlap, estimate and exact measure
on the spot; so leaders decide how soon a link is found, and not whether. If a
quarter of a list is in one component, its other documents are held against all
of that component and each other, once for all such lists; else all documents of
the list against each other, so that its work grows with the square of its
length. Components come from joins of edges with labels; nothing is gathered on
the driver.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole word sequence as
the only shingle; a text of any length is one set; rows with a null id are
linked with nothing and kept; repeated rows with one id are one document in the
links (by one of their texts, if these differ) and share its fate, so that all of
them stay or go; an empty table gives an empty result; extra columns are ignored
by ``components`` and kept by ``dedup_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import discard, durable, reread, text_blocks
from ._text import Words, span_hash, prefix_sums

SKETCH, LEAST_SHARED = 64, 36
SMALL_LIST, LEADERS, LISTS = 24, 6, 6
#: Documents in a block of comparisons: small, so that the blocks of one list are many groups, each of a few MB.
BLOCK = 256
#: Values of full sets that are sorted together.
OWNED = 1 << 22
#: The estimate passes this many standard deviations below the threshold.
SLACK = 5.0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough: sizes first, then the estimate from the union's sketch, then the exact measure, in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if min(len(a), len(b)) > SKETCH:
        union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
        share = len(np.intersect1d(np.intersect1d(a[:SKETCH], b[:SKETCH], assume_unique=True), union, assume_unique=True)) / SKETCH
        if share < least_share(percent, SKETCH):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_share(percent: int, size: int) -> float:
    """The share of a union's sketch that two similar sets have in common, but for SLACK standard deviations."""
    j = percent / 100
    return j - SLACK * (j * (1 - j) / size) ** 0.5


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a block."""
    w = Words(data, offs, lower=True)
    first, key = w.shingles(k)
    edge = np.searchsorted(w.doc[first], np.arange(w.n_docs + 1))
    count = w.counts()
    start = np.concatenate([[0], np.cumsum(count)])
    every = prefix_sums(w.hash) if (count < k).any() and len(w.hash) else None
    key, n_docs = key.view(np.int64), w.n_docs
    del first, w  # a long text fills much of the memory
    out = []
    for d in range(n_docs):
        if count[d] >= k:
            out.append(np.unique(key[edge[d] : edge[d + 1]]))
        elif count[d]:
            out.append(span_hash(every, start[d : d + 1], start[d + 1 : d + 2]).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in text_blocks(batch.column(1)):
            sets = shingle_sets(data, offs, k)
            cols = [
                batch.column(0).slice(i, j - i),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_fingerprint(s) for s in sets], pa.binary()),
                pa.array([x[:SKETCH] for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "fp", "sketch"])


def _full(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of rows (id, text, fp) whose text has that fingerprint; other texts of a repeated id are left out."""
    for batch in batches:
        for i, j, data, offs in text_blocks(batch.column(1)):
            asked = batch.column(2).slice(i, j - i).to_pylist()
            rows = [(r, s) for r, (s, fp) in enumerate(zip(shingle_sets(data, offs, k), asked)) if _fingerprint(s) == fp]
            cols = [batch.column(0).slice(i, j - i).take(pa.array([r for r, _ in rows], pa.int64())), pa.array([s.astype("<i8").tobytes() for _, s in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "hashes"])


def full_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the documents in ``wanted`` (id, fp), from their texts: whole sets are made where a pair asks for them, and never stored for all documents."""
    kind = dict(texts.dtypes)["id"]
    rows = texts.join(wanted.select("id", "fp").distinct(), "id").select("id", "text", "fp")
    return durable(rows.mapInArrow(lambda batches: _full(batches, shingle), f"id {kind}, hashes binary").dropDuplicates(["id"]))


def _jaccard(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough."""
    for batch in batches:
        col = {x: batch.column(k) for k, x in enumerate(batch.schema.names)}
        ok = []
        for r in range(batch.num_rows):
            ok.append(similar(*(np.frombuffer(col[f"hashes_{x}"][r].as_py(), "<i8") for x in "ab"), percent))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    kind = dict(pairs.dtypes)["a"]
    return full.mapInArrow(lambda batches: _jaccard(batches, percent), f"a {kind}, b {kind}")


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that pass the estimate and the exact measure."""
    asked = durable(_estimated(pairs, reps, percent))
    ids = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()
    sets = full_sets(texts, reps.join(ids, "id"), shingle)
    out = durable(_verified(asked, sets, percent))
    discard(asked, sets)
    return out


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose similarity by the union's sketch may reach the threshold."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    both = both.select("a", "b", union.alias("u"), F.array_intersect("s_a", "s_b").alias("i"))
    size = F.size("u")
    share = F.size(F.array_intersect("u", "i")) / size
    j = percent / 100
    return both.where(share >= j - SLACK * F.sqrt(F.lit(j * (1 - j)) / size)).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) with the smallest id of each component, for edges (a, b). Labels are joined to edges and then to themselves, until none changes."""
    both = durable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        step = durable(labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = durable(step.join(jump, "label", "left").select("id", "old", F.least("label", "far").alias("label")))
        discard(labels, step)
        labels = new
        if new.where("label <> old").isEmpty():
            discard(both)
            return labels


def least_shared() -> Column:
    """Values that the sketch of a set of ``n`` shares with that of any similar set: only if no such set can exceed SKETCH are both sketches whole sets."""
    return F.when(100 * F.col("n") > PERCENT_FLOOR * SKETCH, LEAST_SHARED).otherwise(F.ceil(F.col("n") * F.lit(PERCENT_FLOOR) / 100)).cast("int")


class Owners:
    """An inverted list of the values of some sets: how many values each of them shares with another set, for all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, self.parts = len(sets), []
        first, size = 0, np.cumsum([len(x) for x in sets])
        while first < self.n:  # parts of bounded size, one set at least
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + OWNED, "right")))
            values, owner = np.concatenate(sets[first:last]), np.repeat(np.arange(first, last), [len(x) for x in sets[first:last]])
            order = np.argsort(values, kind="stable")
            self.parts.append((values[order], owner[order]))
            first = last

    def shared(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for values, owner in self.parts:
            for i in range(0, len(own), 1 << 14):
                low = np.searchsorted(values, own[i : i + (1 << 14)])
                runs = np.searchsorted(values, own[i : i + (1 << 14)], "right") - low
                at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                out += np.bincount(owner[at], minlength=self.n)
        return out


def _links(outside: pa.Table, block: pa.Table, percent: int) -> pa.Table:
    """Verified links of outsiders to documents of a block, one for each other label: candidates by sketch overlap, best first, exact on full sets."""
    pairs: list[tuple] = []
    if outside.num_rows and block.num_rows:
        docs = block.select(["id", "label", "n", "need"]).to_pylist()
        lists = block.column("sketch").combine_chunks()
        sketches = Owners(np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()))
        need, size = np.array([d["need"] for d in docs]), np.array([d["n"] for d in docs])
        whole: Owners | None = None  # made when the first candidate is there
        for k in range(outside.num_rows):
            r = outside.slice(k, 1).select(["id", "label", "n", "need"]).to_pylist()[0]
            shared = sketches.shared(outside.column("sketch")[k].values.to_numpy())
            near = np.flatnonzero((shared >= np.minimum(need, r["need"])) & (100 * np.minimum(size, r["n"]) >= percent * np.maximum(size, r["n"])))
            near = [m for m in near[np.argsort(-shared[near], kind="stable")].tolist() if docs[m]["label"] != r["label"]]
            if not near:
                continue
            if whole is None:
                whole = Owners([np.frombuffer(h, "<i8") for h in block.column("hashes").to_pylist()])
            mine = np.frombuffer(outside.column("hashes")[k].as_py(), "<i8")
            both, found = whole.shared(mine), set()
            for m in near:
                d = docs[m]
                if d["label"] not in found and 100 * int(both[m]) >= percent * (len(mine) + d["n"] - int(both[m])):
                    found.add(d["label"])
                    pairs.append((min(r["id"], d["id"]), max(r["id"], d["id"])))
    kind = block.schema.field("id").type
    return pa.table({"a": pa.array([a for a, _ in pairs], kind), "b": pa.array([b for _, b in pairs], kind)})


def outsider_links(large: DataFrame, labels: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between documents of long lists that are in different components. Where one component has a quarter of a list or more, the others are held against all of it and each other; else all documents of the list against each other."""
    named = labels.select("id", F.col("label").alias("l"))
    rows = durable(large.select("id", "v").join(named, "id", "left").select("id", "v", F.coalesce("l", "id").alias("label")))
    counts = rows.groupBy("v", "label").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"))
    counts = counts.groupBy("v").agg(F.max_by("label", "c").alias("main"), F.sum("c").alias("m"), F.max("c").alias("c"), F.bit_xor("x").alias("x")).where("c < m")
    # lists of the same documents are one group; if different ones meet by chance, they are held against each other, too
    key = F.when(F.expr("4 * c >= m"), F.concat(F.lit("c"), F.col("main").cast("string"))).otherwise(F.concat(F.lit("v"), F.col("x").cast("string")))
    lists = counts.select("v", F.when(F.expr("4 * c >= m"), F.col("main")).alias("main"), key.alias("key"))
    out = durable(rows.join(lists, "v").where("main is null or label <> main").select("key", "main", "id", "label").distinct())
    members = labels.groupBy(F.col("label").alias("main")).agg(F.count(F.lit(1)).alias("m"))
    size = out.groupBy("key", "main").agg(F.count(F.lit(1)).alias("r")).join(members, "main", "left")
    size = durable(size.select("key", "main", F.ceil(F.col("r") / BLOCK).cast("int").alias("rb"), F.ceil((F.coalesce("m", F.lit(0)) + F.col("r")) / BLOCK).cast("int").alias("mb")))
    inside = labels.select("id", "label").join(size, F.col("label") == F.col("main")).select("key", "id", "label", "rb", "mb", F.lit(False).alias("outer"))
    outer = out.drop("main").join(size, "key").select("key", "id", "label", "rb", "mb", F.lit(True).alias("outer"))
    members = durable(inside.union(outer))  # narrow, so that the sets are joined once, by broadcast if this is small
    asked = reps.join(members.select("id").distinct(), "id").select("id", "fp", "n", least_shared().alias("need"), "sketch")
    sets = full_sets(texts, asked, shingle)
    picked = durable(asked.drop("fp").join(sets, "id").join(members, "id"))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "label", "n", "need", "sketch", "hashes"]
    ask = picked.where("outer").withColumn("j", part("rb", 2)).select("key", "j", every("mb").alias("i"), *cols)
    block = reread(picked).withColumn("i", part("mb", 3)).select("key", every("rb").alias("j"), "i", *cols)
    group, kind = ["key", "i", "j"], dict(rows.dtypes)["id"]
    links = durable(ask.groupBy(*group).cogroup(block.groupBy(*group)).applyInArrow(lambda a, b: _links(a, b, percent), f"a {kind}, b {kind}"))
    discard(rows, out, size, members, sets, picked)
    return links


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b that meet in a list, with the shared values counted; the rows of lists with their lengths m)."""
    values = reps.select("id", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = values.join(common, "v")
    own = listed.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum(F.log("df")).alias("weight"))  # at most SKETCH values
    kept = F.least(F.col("n"), F.lit(SKETCH))
    rare = kept - F.size("vs")  # values that no other document has
    prefix = own.select("id", "weight", F.explode(F.slice("vs", F.lit(1), F.greatest(F.lit(0), kept - least_shared() + 1 - rare).cast("int"))).alias("x"))
    prefix = durable(prefix.select("id", "weight", F.col("x.v").alias("v"), F.col("x.df").alias("df")))
    size = prefix.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    all_rows, prefix = prefix, durable(prefix.join(size, "v").select("id", "weight", "v", "m"))
    discard(all_rows)
    small = prefix.where(F.col("m") <= SMALL_LIST).select("v", F.col("id").alias("a"))
    pairs = small.join(small.withColumnRenamed("a", "b"), "v").where("a < b").select("a", "b")
    large = prefix.where(F.col("m") > SMALL_LIST)
    leaders = large.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("slice")).agg(F.max_by("id", F.struct("weight", "id")).alias("lead"))
    shortest = large.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("m", "v"))), 1, LISTS).alias("vs"))  # of at most SKETCH lists
    led = shortest.select("id", F.explode("vs.v").alias("v")).join(leaders, "v").where("id <> lead")
    pairs = pairs.union(led.select(F.least("id", "lead"), F.greatest("id", "lead")))
    return durable(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))), prefix


#: The least threshold, in percent, that the lists of small sets must serve.
PERCENT_FLOOR = 80


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (the smallest id that links reach) and ``kept`` (it is that document)."""
    if percent < PERCENT_FLOOR:
        raise ValueError(f"the sketches serve thresholds from {PERCENT_FLOOR} percent on")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["id"]
    sets = durable(narrow.mapInArrow(lambda batches: _sketches(batches, shingle), f"id {kind}, n long, fp binary, sketch array<long>"))
    linked = sets.where("n > 0 and id is not null")
    classes = durable(linked.groupBy("fp").agg(F.min("id").alias("rep")))
    rep_ids = classes.select(F.col("rep").alias("id"), "fp")
    reps = durable(linked.join(rep_ids, ["id", "fp"], "left_semi").dropDuplicates(["id"]).select("id", "n", "fp", "sketch"))
    pairs, prefix = candidates(reps)
    both = pairs.select("a", "b", "c").union(pairs.select("b", "a", "c"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("c", F.col("b"))).alias("x"), F.max_by("b", F.struct(F.when(F.col("c") > 1, 1).otherwise(0), -F.col("b"))).alias("y"))
    first = best.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = durable(first)
    done = [verified(first, narrow, reps, shingle, percent)]
    labels = connected(done[0])
    side = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
    left = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    open_ = left.where(~F.coalesce(F.col("l_a") == F.col("l_b"), F.lit(False))).select("a", "b")
    large = prefix.where(F.col("m") > SMALL_LIST)
    for step in ("candidates", "outsiders"):
        if step == "candidates":
            more = verified(open_, narrow, reps, shingle, percent)
        elif large.isEmpty():
            break
        else:
            more = outsider_links(large, labels, narrow, reps, shingle, percent)
        done.append(more)
        if not more.isEmpty():
            old, labels = labels, connected(reduce(DataFrame.union, done))
            discard(old)
    discard(pairs, prefix, first, reps, *done)
    of_class = classes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("c"))
    out = sets.select("id", "n", "fp").join(of_class, "fp", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.least("c", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component, with all columns; repeated rows of that document all stay."""
    found = components(docs, id_col, text_col, shingle, percent)
    go = found.where("not kept").select(F.col(id_col).alias("__nd_id")).distinct()
    return docs.join(go, docs[id_col].eqNullSafe(go["__nd_id"]), "left_anti")


#: The components of two-word shingles in DuckDB, from all pairs that share a shingle; for small tables.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
