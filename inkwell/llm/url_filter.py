"""URL filters: rules first, then a tree of path templates per host.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's; the longest wins, and of equally long ones the last in the
list. Other urls are judged by templates: the path is cut into segments,
segments that are numbers, hex strings or dates become wildcards, and, level by
level, so does every segment of a node that has more than ``MAX_CHILDREN``
different ones. Then, from the deepest level up, sibling branches of each node
(equal but for one segment) are merged with the one of the most labels, if their
shares of blocked urls do not differ from its share by more than chance; those
that differ keep their own counts and stay out of the sum. A branch without labels
differs from its siblings by nothing that is known: it is judged by the counts of all
of them, at the deepest level at which they have any, and else by those of its host. A
template is rejected if its smoothed share of allowed urls, ``(allowed + PRIOR) /
(labelled + 2 * PRIOR)``, is below ``MIN_PURITY``; on a host without labels it is a
half, which allows. The labels are the verdicts of the rules.

The tree is built from counts per host and path shape, summed on the map side,
so a host with a third of all urls costs as many rows as it has shapes a task.
Segments beyond ``DEPTH`` are one wildcard in the templates.

Defined cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is judged as the template of the empty host; repeated rows count
each; urls of any length are split whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import discard, durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
Rule = tuple[str, str, str]
DEPTH, MAX_CHILDREN = 8, 20
PRIOR, MIN_PURITY, Z = 1.0, 0.5, 2.0
# Shapes of variable segments.
VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{1,4}(?:-[0-9]{1,2}){1,2}|[A-Za-z]*[0-9]{4,}[A-Za-z]*)(\.[A-Za-z0-9]{1,5})?$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, or nulls."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    struct = lambda k, h, p, v: F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(k).alias("k"), F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v"))
    every = F.array(*(struct(k, *r) for k, r in enumerate(rules)))
    fits = lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"])
    best = F.array_max(F.filter(every, fits))
    return F.concat(best["h"], best["p"]), best["v"]


def shape_of(path: Column) -> Column:
    """Segments with variable ones as wildcards that keep the extension; what lies beyond DEPTH is one wildcard."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    known = F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, VARIABLE, 1))).otherwise(s))
    return F.when(F.size(known) > DEPTH, F.concat(F.slice(known, 1, DEPTH), F.array(F.lit("**")))).otherwise(known)


def templates(labelled: DataFrame, depth: int = DEPTH) -> DataFrame:
    """From rows (host, shape, verdict or null) one row for each host and shape: its template and the allowed and labelled urls of its merged branch."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tree = labelled.groupBy("host", "shape").agg(count(F.col("verdict") == "allow").alias("good"), count(F.col("verdict").isNotNull()).alias("n"))
    tree = durable(tree.withColumn("template", F.col("shape")))
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(min(depth, deepest)):  # a bounded number of levels, over counted shapes
        above = F.slice("template", 1, level)
        node = tree.withColumns({"above": above, "child": F.get("template", F.lit(level))})
        wide = node.where("child is not null").select("host", "above", "child").distinct().groupBy("host", "above").agg(F.count(F.lit(1)).alias("kids")).where(F.col("kids") > MAX_CHILDREN)
        node = node.join(wide, ["host", "above"], "left")
        star = F.concat(F.col("above"), F.array(F.lit("*")), F.slice("template", level + 2, depth + 1))
        node = node.withColumn("template", F.when(F.col("kids").isNotNull() & F.col("child").isNotNull(), star).otherwise(F.col("template")))
        old, tree = tree, durable(node.select("host", "shape", "good", "n", "template"))
        discard(old)
    none = F.lit(0).cast("long")
    branch = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumns({"lent_good": none, "lent_n": none})
    for level in reversed(range(deepest)):
        branch = merged(branch, level, depth)
    host = durable(tree.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")))
    own, lent = F.col("n") > 0, F.col("lent_n") > 0
    pick = lambda c: F.when(own, F.col(c)).when(lent, F.col(f"lent_{c}")).otherwise(F.col(f"host_{c}")).alias(c)
    branch = branch.join(host, "host").select("host", "template", pick("good"), pick("n"))
    return tree.select("host", "shape", "template").join(branch, ["host", "template"])


def merged(branch: DataFrame, level: int, depth: int = DEPTH) -> DataFrame:
    """Branches with labels that differ in one segment only share their counts with the one of the most labels, if their shares differ from its share by chance. Those without labels get those of the family on loan, which they do not pass on. A node has few siblings, as wide ones are wildcards by now."""
    family = F.concat(F.slice("template", 1, level), F.array(F.lit("?")), F.slice("template", level + 2, depth + 1))
    rows = branch.withColumn("family", F.when(F.size("template") > level, family))
    w = Window.partitionBy("host", F.coalesce("family", "template"), F.col("family").isNull())
    most = w.orderBy(F.desc("n"), F.desc("template")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"top_good": F.first("good").over(most), "top_n": F.first("n").over(most)})
    q = (F.col("good") + F.col("top_good")) / (F.col("n") + F.col("top_n"))
    apart = F.abs(F.col("good") / F.col("n") - F.col("top_good") / F.col("top_n"))
    near = F.coalesce(F.when(F.col("n") > 0, apart <= Z * F.sqrt(q * (1 - q) * (1.0 / F.col("n") + 1.0 / F.col("top_n")))), F.lit(False))
    rows = rows.withColumn("near", near)
    pool = lambda c: F.when(F.col("near"), F.sum(F.when(F.col("near"), F.col(c)).otherwise(0)).over(w)).otherwise(F.col(c)).alias(c)
    borrows = (F.col("n") == 0) & (F.col("lent_n") == 0)
    loan = lambda c: F.when(borrows, F.sum(c).over(w)).otherwise(F.col(f"lent_{c}")).alias(f"lent_{c}")
    return rows.select("host", "template", pool("good"), pool("n"), loan("good"), loan("n"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, ``host``, ``path``, the ``rule`` that fits, ``verdict``, and the ``template`` and its ``purity`` that decide where no rule does."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict, "shape": shape_of(F.col("path"))})
    tree = templates(rows.select("host", "shape", F.col("given").alias("verdict")))
    purity = (F.col("good") + PRIOR) / (F.col("n") + 2 * PRIOR)
    judged = rows.join(tree, ["host", "shape"], "left")
    return judged.select(
        id_col, "host", "path", "rule", F.coalesce("given", F.when(purity < MIN_PURITY, "block").otherwise("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), purity.alias("purity")
    )


def sql(rules: list[Rule]) -> str:
    """The judgement in DuckDB, with the levels of the tree written out."""
    rule, verdict = "NULL", "NULL"
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    levels = []
    for k in range(DEPTH):
        above = f"template[1:{k}]" if k else "CAST([] AS VARCHAR[])"
        levels.append(
            f"""w{k} AS MATERIALIZED (SELECT host, above FROM (SELECT DISTINCT host, {above} AS above, template[{k + 1}] AS child FROM t{k} WHERE len(template) > {k}) GROUP BY host, above HAVING count(*) > {MAX_CHILDREN}),
t{k + 1} AS MATERIALIZED (SELECT t.host, shape, good, n, CASE WHEN w.host IS NOT NULL THEN list_concat(list_concat({above}, ['*']), template[{k + 2}:]) ELSE template END AS template FROM t{k} t LEFT JOIN w{k} w ON w.host = t.host AND w.above = {above} AND len(template) > {k})"""
        )
    merges = []
    for k in range(DEPTH, -1, -1):
        before, after = f"g{k + 1}", f"g{k}"
        family = f"CASE WHEN len(template) > {k} THEN list_concat(list_concat(template[1:{k}], ['?']), template[{k + 2}:]) END"
        merges.append(
            f"""f{k} AS (SELECT *, first_value(good) OVER w AS top_good, first_value(n) OVER w AS top_n FROM (SELECT *, {family} AS family FROM {before}) WINDOW w AS (PARTITION BY host, coalesce(family, template), family IS NULL ORDER BY n DESC, template DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h{k} AS (SELECT *, coalesce(CASE WHEN n > 0 THEN abs(good / n - top_good / top_n) <= {Z} * sqrt(CAST((good + top_good) / (n + top_n) * (1 - (good + top_good) / (n + top_n)) * (1.0::DOUBLE / n + 1.0::DOUBLE / top_n) AS DOUBLE)) END, false) AS near FROM f{k}),
{after} AS MATERIALIZED (SELECT host, template, CASE WHEN near THEN CAST(sum(good) FILTER (WHERE near) OVER w AS BIGINT) ELSE good END AS good, CASE WHEN near THEN CAST(sum(n) FILTER (WHERE near) OVER w AS BIGINT) ELSE n END AS n,
CASE WHEN n = 0 AND lent_n = 0 THEN CAST(sum(good) OVER w AS BIGINT) ELSE lent_good END AS lent_good, CASE WHEN n = 0 AND lent_n = 0 THEN CAST(sum(n) OVER w AS BIGINT) ELSE lent_n END AS lent_n FROM h{k} WINDOW w AS (PARTITION BY host, coalesce(family, template), family IS NULL))"""
        )
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '*' || regexp_extract(x, '{VARIABLE}', 1) ELSE x END) AS k, {rule} AS rule, {verdict} AS given FROM u),
r AS MATERIALIZED (SELECT page_id, host, path, rule, given, CASE WHEN len(k) > {DEPTH} THEN list_concat(k[1:{DEPTH}], ['**']) ELSE k END AS shape FROM s),
t0 AS MATERIALIZED (SELECT host, shape, shape AS template, count(*) FILTER (WHERE given = 'allow') AS good, count(given) AS n FROM r GROUP BY host, shape),
{(","+chr(10)).join(levels)},
g{DEPTH + 1} AS MATERIALIZED (SELECT host, template, CAST(sum(good) AS BIGINT) AS good, CAST(sum(n) AS BIGINT) AS n, 0::BIGINT AS lent_good, 0::BIGINT AS lent_n FROM t{DEPTH} GROUP BY host, template),
o AS MATERIALIZED (SELECT host, CAST(sum(good) AS BIGINT) AS host_good, CAST(sum(n) AS BIGINT) AS host_n FROM t{DEPTH} GROUP BY host),
{(","+chr(10)).join(merges)},
p AS (SELECT t.host, t.shape, t.template, (CASE WHEN m.n > 0 THEN m.good WHEN lent_n > 0 THEN lent_good ELSE host_good END + {PRIOR}) / (CASE WHEN m.n > 0 THEN m.n WHEN lent_n > 0 THEN lent_n ELSE host_n END + {2 * PRIOR}) AS purity FROM t{DEPTH} t JOIN g0 m ON m.host = t.host AND m.template = t.template JOIN o ON o.host = t.host)
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(template, '/') AS template, CAST(purity AS DOUBLE) AS purity FROM r LEFT JOIN p ON p.host = r.host AND p.shape = r.shape
"""
