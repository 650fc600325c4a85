"""Judging urls: rules for hosts and paths first, and for all else a tree of path templates for each host.

Pages meet the tree as counts of path shapes, so a host of any size is a few rows; the tree grows level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ("n", "known", "bad")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and then up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    text = lambda pattern, group: F.coalesce(F.regexp_extract(rest, pattern, group), F.lit(""))
    return F.translate(text("^[^/?#]*", 0), _UPPER, _LOWER), text("^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule fits its host and all below it, and paths that start with its own."""
    rule = verdict = F.lit(None).cast("string")
    for kind, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(path: Column, depth: int, longest: int = 24) -> Column:
    """The path's first ``depth`` parts, and ``**`` for all beyond. A part with a digit, of more than ``longest``
    characters, or of four words or more is a wildcard, with its extension."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    varies = lambda p: p.rlike(r"[0-9]|[-_+.][^-_+.]+[-_+.][^-_+.]+[-_+.]") | (F.length(p) > longest)
    wild = F.transform(F.slice(parts, 1, depth), lambda p: F.when(varies(p), F.concat(F.lit("*"), F.regexp_extract(p, r"\.[a-z]{1,5}\z", 0))).otherwise(p))
    return F.when(F.size(parts) > depth, F.concat(wild, F.array(F.lit("**")))).otherwise(wild)


def purity(n: Column, known: Column, bad: Column, mass: float) -> Column:
    """Smoothed share of bad pages: a page without a label, and ``mass`` more, count as half bad."""
    return (bad + (n - known + mass) * 0.5) / (n + mass)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, *, bad: Column | None = None, depth: int = 3, least: int = 5, share: float = 0.01, apart: float = 3.84, mass: float = 2.0, reject: float = 0.8) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, purity.

    The verdict is the longest fitting rule's, else the method's. ``rules`` are a parameter, of at most some hundreds.
    ``bad`` labels pages (true, false, or null: unknown); by default the pages that a rule blocks or allows.

    Template tree: of a node's branches, those with fewer than ``least`` pages or ``share`` of the node's become one
    wildcard, so at most 1 / share + 1 are left. In order of purity, neighbours whose purities don't differ (z squared
    up to ``apart``) are merged. A page's template is its deepest node; it is rejected where its purity, over all pages
    at and below it, is ``reject`` or more. A node without labels has a purity of a half: allowed.

    A null url or one without ``://`` has an empty host and path, and a tree with all its like. Rows that repeat count as
    pages; parts of any length and number are read whole; an empty table gives no rows. Other columns are not read.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), *([] if bad is None else [bad.alias("given")]))
    host, path = host_and_path(F.col("url"))
    p = p.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "ruled": verdict, "parts": shape(F.col("path"), depth)})
    label = F.col("ruled") == "block" if bad is None else F.col("given")
    shapes = save(p.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count(label).alias("known"), F.count_if(label).alias("bad")), "shapes")

    add = [F.sum(c).alias(c) for c in _COUNTS]
    nodes = [shapes.groupBy("host").agg(*add).select("host", F.lit("/").alias("template"), *_COUNTS)]
    at = shapes.withColumn("template", F.lit("/"))
    for k in range(depth + 1):
        kids = at.where(F.size("parts") > k).groupBy("host", "template", F.get("parts", F.lit(k)).alias("part")).agg(*add)
        all_of = kids.groupBy("host", "template").agg(F.sum("n").alias("all"))
        kids = kids.join(all_of, ["host", "template"]).withColumn("branch", F.when(F.col("n") >= F.greatest(F.lit(least), F.col("all") * share), F.col("part")).otherwise("*"))
        branches = kids.groupBy("host", "template", "branch").agg(*add).withColumn("p", purity(*map(F.col, _COUNTS), mass)).withColumn("w", F.col("n") + mass)
        line = W.partitionBy("host", "template").orderBy("p", "branch")
        p0, w0 = F.lag("p").over(line), F.lag("w").over(line)
        pooled = (F.col("p") * F.col("w") + p0 * w0) / (F.col("w") + w0)
        z2 = (F.col("p") - p0) * (F.col("p") - p0) / (pooled * (1 - pooled) * (1 / F.col("w") + 1 / w0))
        branches = branches.withColumn("new", F.coalesce((z2 > apart).cast("int"), F.lit(0)))
        branches = branches.withColumn("set", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
        merged = branches.groupBy("host", "template", "set").agg(F.array_sort(F.collect_list("branch")).alias("names"), *add)
        merged = save(merged.withColumn("next", F.concat("template", F.array_join("names", "|"), F.lit("/"))), "templates")
        nodes.append(merged.select("host", F.col("next").alias("template"), *_COUNTS))
        names = kids.select("host", "template", "part", "branch").join(merged.select("host", "template", "next", F.explode("names").alias("branch")), ["host", "template", "branch"])
        moved = at.withColumn("part", F.get("parts", F.lit(k))).join(names.select("host", "template", "part", "next"), ["host", "template", "part"], "left")
        at = save(moved.select("host", "parts", *_COUNTS, F.coalesce("next", "template").alias("template")), "shapes")
    tree = nodes[0]
    for more in nodes[1:]:
        tree = tree.unionByName(more)
    tree = tree.select("host", "template", F.round(purity(*map(F.col, _COUNTS), mass), 9).alias("purity"))
    known = at.select("host", "parts", "template").join(tree, ["host", "template"])
    found = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return p.join(known, ["host", "parts"]).select("page_id", "host", "path", "rule", found.alias("verdict"), "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle(depth: int = 3) -> str:
    """SQL of the query, with judge()'s defaults."""
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '/{p}%'"
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(*r.split('/', 1))} THEN '{r}'" for _, r in ordered) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{kind}'" for kind, r in ordered) + " END"
    pure, add = "(bad + (n - known + 2.0::DOUBLE) * 0.5::DOUBLE) / (n + 2.0::DOUBLE)", ", ".join(f"sum({c}) AS {c}" for c in _COUNTS)
    wild = r"list_transform(parts[1:3], lambda x: CASE WHEN length(x) > 24 OR regexp_matches(x, '[0-9]|[-_+.][^-_+.]+[-_+.][^-_+.]+[-_+.]') THEN '*' || regexp_extract(x, '\.[a-z]{1,5}\z', 0) ELSE x END)".replace("1:3", f"1:{depth}")
    ctes = [
        "u0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"u1 AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u0)",
        f"u2 AS (SELECT *, {rule} AS rule, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u1)",
        f"u AS (SELECT page_id, host, path, rule, {ruled} AS ruled, CASE WHEN len(parts) > {depth} THEN list_append({wild}, '**') ELSE {wild} END AS parts FROM u2)",
        "a0 AS (SELECT host, parts, count(*) AS n, count(ruled) AS known, count(*) FILTER (ruled = 'block') AS bad, '/' AS template FROM u GROUP BY host, parts)",
        f"t0 AS (SELECT host, '/' AS template, {add} FROM a0 GROUP BY host)",
    ]
    for k in range(depth + 1):
        ctes += [
            f"k{k} AS (SELECT *, CASE WHEN n >= greatest(5, sum(n) OVER (PARTITION BY host, template) * 0.01::DOUBLE) THEN part ELSE '*' END AS branch FROM (SELECT host, template, parts[{k + 1}] AS part, {add} FROM a{k} WHERE len(parts) > {k} GROUP BY ALL))",
            f"b{k} AS (SELECT *, lag(p) OVER line AS p0, lag(w) OVER line AS w0 FROM (SELECT *, {pure} AS p, n + 2.0::DOUBLE AS w FROM (SELECT host, template, branch, {add} FROM k{k} GROUP BY ALL)) WINDOW line AS (PARTITION BY host, template ORDER BY p, branch))",
            f"c{k} AS (SELECT *, coalesce((p - p0) * (p - p0) / (q * (1 - q) * (1 / w + 1 / w0)) > 3.84::DOUBLE, false)::INT AS new FROM (SELECT *, (p * w + p0 * w0) / (w + w0) AS q FROM b{k}))",
            f"d{k} AS (SELECT host, template, set, template || array_to_string(list_sort(list(branch)), '|') || '/' AS next, list(branch) AS names, {add} FROM (SELECT *, sum(new) OVER (PARTITION BY host, template ORDER BY p, branch) AS set FROM c{k}) GROUP BY host, template, set)",
            f"t{k + 1} AS (SELECT host, next AS template, n, known, bad FROM d{k})",
            f"a{k + 1} AS (SELECT a.host, a.parts, a.n, a.known, a.bad, coalesce(d.next, a.template) AS template FROM a{k} a LEFT JOIN k{k} c ON c.host = a.host AND c.template = a.template AND c.part = a.parts[{k + 1}] LEFT JOIN d{k} d ON d.host = c.host AND d.template = c.template AND list_contains(d.names, c.branch))",
        ]
    tree = " UNION ALL ".join(f"SELECT host, template, round({pure}, 9) AS purity FROM t{k}" for k in range(depth + 2))
    return f"WITH {', '.join(ctes)}, tree AS ({tree}) SELECT page_id, u.host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity FROM u JOIN a{depth + 1} a ON a.host = u.host AND a.parts = u.parts JOIN tree t ON t.host = a.host AND t.template = a.template"


ORACLE_SQL = _oracle()
