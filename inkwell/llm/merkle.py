"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

``H`` is the lower-case hex SHA-256 of its inputs, concatenated; digests go in as
hex text. A leaf is H of the row's fields, each ``-`` if null, else its UTF-8
bytes counted, ``:``, and the value. In a tree of more than one node, every three
consecutive nodes (the last run may have fewer, even one) become their H, level by
level, until one is left. The leaves of a source stand in the order of their ids,
and the roots of the sources in the order of their names, a null source first.

Blocks of 3 ** ``LEVELS`` leaves that begin at a multiple of that are whole subtrees. An executor gets such a block as an Arrow table and runs the level
queries on it in DuckDB: an ordered ``string_agg`` of three nodes, and its sha256.
Block roots are the leaves of the next round, so there are as many rounds as the
largest source's size has powers of a block's. On the way down each block is joined to
the proof of its root; leaves cross the network for their order, for the way up and
for the way down, as digests without texts, and proofs never do.

Places in the order come from a range partitioning and counts per partition, so no
source, and no repeated id, is gathered in one task.

Defined cases: ids ascend with nulls first; rows of one id stand in the order of
their leaves, equal rows in any order, which changes no row of the result; a null
source is a source of its own; an empty string is a value and not a null; texts of any
length are hashed whole; a single leaf is its source's root, and a single source's root
is the root; an empty table gives an empty manifest; extra columns are ignored
unless named in ``carry``.
"""

from __future__ import annotations

import functools

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import discard, durable

#: Nodes of a run, and levels of a block (a parameter).
ARITY, LEVELS = 3, 6
#: Memory that the block engine may take in one Python worker; a block takes some megabytes.
ENGINE_MEMORY = "256MB"
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
PROOF_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields."""
    each = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*each), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in order, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


# the block engine


@functools.cache
def engine() -> duckdb.DuckDBPyConnection:
    """A worker's own in-memory database."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": ENGINE_MEMORY, "temp_directory": ""})


@functools.cache
def levels_sql(levels: int, span: int) -> str:
    """CTEs of a block's levels: ``l0`` (i, h) to ``l{levels}``, and ``r{k}`` (i, run), the three nodes below each node as one text."""
    parts = [f"l0 AS MATERIALIZED (SELECT pos % {span} AS i, h FROM nodes)"]
    for k in range(levels):
        parts.append(f"r{k} AS MATERIALIZED (SELECT i // {ARITY} AS i, string_agg(h, '' ORDER BY i) AS run FROM l{k} GROUP BY 1)")
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT i, sha256(run) AS h FROM r{k})")
    return "WITH " + ",\n".join(parts)


@functools.cache
def proof_sql(levels: int, span: int) -> str:
    """Each node's place with its proof within the block."""
    step = lambda k: f"n.pos % {span} // {ARITY**k}"
    own = lambda k: f"({step(k)}) % {ARITY} * {DIGEST}"
    pairs = ", ".join(f"struct_pack(\"left\" := substr(r{k}.run, 1, {own(k)}), \"right\" := substr(r{k}.run, {own(k)} + {DIGEST + 1}))" for k in range(levels))
    joins = "".join(f" JOIN r{k} ON r{k}.i = {step(k + 1)}" for k in range(levels))
    return f"{levels_sql(levels, span)}\nSELECT n.pos, [{pairs}] AS proof FROM nodes n{joins} ORDER BY n.pos"


def block_levels(n: int, most: int = LEVELS) -> int:
    """Levels of a block in a tree of n nodes: all, or as many as leave one."""
    return next(k for k in range(most + 1) if k == most or ARITY**k >= n)


def run_block(table: pa.Table, sql: str) -> pa.Table:
    con = engine()
    con.register("nodes", table.select(["pos", "h"]))
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("nodes")


def block_root(table: pa.Table, most: int = LEVELS) -> pa.Table:
    """The root of one block, as a node of the next round."""
    n, span = table.column("n")[0].as_py(), ARITY**most
    levels = block_levels(n, most)
    root = run_block(table, f"{levels_sql(levels, span)}\nSELECT h FROM l{levels}").column("h")
    if len(root) != 1:
        raise ValueError(f"a block of {table.num_rows} nodes has {len(root)} roots: places are not dense")
    pos = table.column("pos")[0].as_py() // span
    return pa.table({"grp": table.column("grp").slice(0, 1), "pos": pa.array([pos], pa.int64()), "h": root.cast(pa.string()), "n": pa.array([-(-n // span)], pa.int64())})


def block_proofs(nodes: pa.Table, above: pa.Table, most: int = LEVELS) -> pa.Table:
    """The nodes of one block with their proofs up to the root, which end with the proof of the block's own root; all columns of ``above`` but its place go along."""
    levels = block_levels(nodes.column("n")[0].as_py(), most)
    nodes = nodes.sort_by("pos")
    if levels:
        inner = run_block(nodes, proof_sql(levels, ARITY**most)).column("proof").combine_chunks().cast(PROOF_TYPE)
    else:
        inner = pa.array([[]] * nodes.num_rows, PROOF_TYPE)
    outer = above.column("proof").combine_chunks().values
    size = levels + len(outer)
    values = pa.concat_arrays([inner.values, *([outer] if len(outer) else [])])
    take = [k for r in range(nodes.num_rows) for k in (*range(r * levels, (r + 1) * levels), *range(len(inner.values), len(values)))]
    proof = pa.ListArray.from_arrays(pa.array(range(0, size * nodes.num_rows + 1, size or 1) if size else [0] * (nodes.num_rows + 1), pa.int32()), values.take(pa.array(take, pa.int64())))
    constants = {c: pa.repeat(above.column(c)[0], nodes.num_rows) for c in above.column_names if c not in ("grp", "pos", "block", "proof")}
    return pa.table({c: nodes.column(c) for c in nodes.column_names if c not in ("h", "n", "block")} | {"proof": proof} | constants)


# Spark's part: order, rounds, joins of proofs


def laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written in the order of ``grp`` and those columns, with ``__at``, which ascends in that order, and its partition ``__part``. The ranges cut groups of any size, down to equal rows."""
    keys = ["grp", *order, "__tie"]
    lying = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return durable(lying.drop("__tie").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place within ``grp`` in that order from 0, and ``n``, the size of the group; counts per group and partition tell where each begins."""
    placed = laid_out(rows, order)
    each = placed.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("grp")  # as many rows as partitions
    each = each.withColumns({"n": F.sum("__n").over(whole), "__before": F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    each = durable(each.drop("__n"))  # its size is known, so Spark broadcasts it where it is small
    return placed.join(each, ["grp", "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels))


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rows (grp, pos, h, n) of each round, up to one node for each group."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = in_blocks(rounds[-1].select("grp", "pos", "h", "n"), levels)
        rounds.append(durable(below.groupBy("grp", "block").applyInArrow(lambda t: block_root(t, levels), "grp string, pos long, h string, n long")))
        most = -(-most // ARITY**levels)
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes of the first round with their proofs, from ``above`` (grp, pos, proof, ...) of the last one."""
    for nodes in reversed(rounds[:-1]):
        kept = [f"`{c}` {t}" for c, t in nodes.dtypes if c not in ("h", "n")]
        more = [f"`{c}` {t}" for c, t in above.dtypes if c not in ("grp", "pos", "proof")]
        roots = above.withColumn("block", F.col("pos"))
        both = in_blocks(nodes, levels).groupBy("grp", "block").cogroup(roots.groupBy("grp", "block"))
        above = both.applyInArrow(lambda a, b: block_proofs(a, b, levels), ", ".join([*kept, f"proof {PROOF}", *more]))
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each document: its id, source, ``leaf``, ``subroot``, ``root`` and ``proof``, an array of the siblings left and right of its path, and the columns of ``carry``."""
    carry = carry or {}
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("__id"), source.alias("__source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("grp"), leaf_of(*(F.col(c) for c in fields)).alias("h"), *(c.alias(f"__c_{k}") for k, c in carry.items())
    )  # the names of groups sort like the sources, with null first
    leaves = durable(rows)
    nodes = numbered(leaves, ["__id", "h"]).withColumn("leaf", F.col("h"))
    rounds = climb(nodes, levels)
    if len(rounds) == 1:  # no row, or no source with more than one
        tops = nodes.select("grp", "pos", "h")
    else:
        tops = rounds[-1].select("grp", "pos", "h")
    named = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("h")), ["name"]).withColumn("subroot", F.col("h"))
    outer = climb(named, levels)
    no_proof = F.array().cast(PROOF).alias("proof")
    if len(outer) == 1:
        of_sources = named.select("name", no_proof, "subroot", F.col("h").alias("root"))
    else:
        of_sources = descend(outer, outer[-1].select("grp", "pos", no_proof, F.col("h").alias("root")), levels).select("name", "proof", "subroot", "root")
    above = of_sources.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "proof", "subroot", "root")
    if len(rounds) == 1:
        done = nodes.drop("h", "n", "pos").join(above.drop("pos"), "grp")
    else:
        done = descend(rounds, durable(above), levels)
    discard(leaves)
    return done.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), "leaf", "subroot", "root", "proof", *(F.col(f"__c_{k}").alias(k) for k in carry))


def verified(rows: DataFrame, seen: str = "seen") -> DataFrame:
    """``rows`` of a manifest with ``folded_root``, from the leaf in ``seen`` and the proof, and ``verified``: is it the root?"""
    return rows.withColumn("folded_root", folded(F.col(seen), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 20) -> str:
    """The query in DuckDB, its levels written out; enough for 3 ** levels leaves a source."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    # the lowest bit of CRC-32, over the bits of the decimal id
    crc = "list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: ((ord(c) >> CAST(b AS INTEGER)) & 1)::UBIGINT)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    out = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('seen')} AS seen FROM (SELECT *, CASE WHEN {crc} & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents))",
        "a0 AS MATERIALIZED (SELECT doc_id, source, leaf, seen, leaf AS h, seen AS cur, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
    ]

    def tree(rows: str, group: str, start: str) -> None:
        """Appends the levels of nodes ``{start}0`` (group, pos, h), and of the rows ``{rows}0`` with what they gather."""
        for k in range(levels):
            same = f"r.{group} IS NOT DISTINCT FROM x.{group} AND r.pos = x.pos // 3" if group else "r.pos = x.pos // 3"
            key = f"{group}, " if group else ""
            many = f"count(*) OVER ({f'PARTITION BY {group}' if group else ''})"
            out.append(f"{start}r{k} AS MATERIALIZED (SELECT {key}pos // 3 AS pos, string_agg(h, '' ORDER BY pos) AS run, any_value(n) AS n FROM (SELECT {key}pos, h, {many} AS n FROM {start}{k}) GROUP BY {key}pos // 3)")
            out.append(f"{start}{k + 1} AS MATERIALIZED (SELECT {key}pos, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {start}r{k})")
            left, right = "substr(run, 1, x.pos % 3 * 64)", "substr(run, x.pos % 3 * 64 + 65)"
            out.append(f"{rows}{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN n > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, proof || {left} || {right} AS proof, x.pos // 3 AS pos) FROM {rows}{k} x JOIN {start}r{k} r ON {same})")

    out.append("s0 AS MATERIALIZED (SELECT source, pos, h FROM a0)")
    tree("a", "source", "s")
    out.append(f"t0 AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM s{levels})")
    out.append(f"b0 AS MATERIALIZED (SELECT a.* REPLACE (t.pos AS pos), t.h AS subroot FROM a{levels} a JOIN t0 t ON a.source IS NOT DISTINCT FROM t.source)")
    tree("b", "", "t")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, top AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top AS verified FROM b{levels} CROSS JOIN (SELECT h AS top FROM t{levels})"


SQL = _sql()
