"""URL filters: host and path rules, then a tree of path templates with labelled purity.

Each host has a tree of path segments, in which digits are a variable. The tree is generalised from the root down, each
level on what the levels above it have become. A child that has less than one part in CHILDREN of its node's distinct
paths is rare. Where a node has CHILDREN rare children or more, its segment is a variable, however many pages there are:
its rare children are merged into one branch, {*}, but for those whose labelled rate differs from that of all rare ones
together by more than chance, which stay by name. The leaves are templates. Sibling templates whose labelled rates do not
differ from their pool by more than chance share their evidence, and a template is rejected if its purity, smoothed
towards its host's and that towards the corpus's, is under a threshold.

All of it is sums by key with map-side parts; keys with many rows, such as a host's root, are dealt over several tasks
where sums meet paths again. Segments behind the LEVELS-th are one with it, so that a path of any length has a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (rule, verdict): a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: A child is rare under one part in so many of its node's paths; so many rare ones make a variable.
CHILDREN = 8
LEVELS = 6
#: Labels that a prior is worth; deviations that branches may differ by; purity below which a template goes.
PRIOR, DEVIATIONS, PURITY = 10.0, 1.96, 0.5
#: Of n labels, g good ones, against a pool of pn labels, pg good ones, that they are part of: more than chance, by the
#: normal approximation with a continuity correction, free of roots so that it rounds alike everywhere.
DISTINCT = f"""2 * abs(g * pn - n * pg) > pn AND CAST(2 * abs(g * pn - n * pg) - pn AS DOUBLE) * CAST(2 * abs(g * pn - n * pg) - pn AS DOUBLE) * pn
    > {4 * DEVIATIONS * DEVIATIONS} * CAST(n AS DOUBLE) * pg * (pn - pg) * (pn - n)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        at, slash, start = r.partition("/")
        fits = ((h == at) | h.endswith("." + at)) & p.startswith(slash + start)
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The path's segments, digits as {n}; those from the LEVELS-th on are one."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "{n}"))
    return F.when(F.size(parts) <= LEVELS, parts).otherwise(F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(F.slice(parts, LEVELS, F.size(parts)), "/"))))


def variable(children: DataFrame) -> DataFrame:
    """(host, node, child) of the children that are one branch, from their paths, labels n and good ones g."""
    at = ["host", "node"]
    totals = children.groupBy(*at).agg(F.sum("paths").alias("total"), F.count("*").alias("n"))
    hot = shared.hot_keys(totals, at)
    rare = shared.join_spread(children, totals.drop("n"), at, hot, "inner").where(F.col("paths") * CHILDREN < F.col("total"))
    pools = rare.groupBy(*at).agg(F.count("*").alias("c"), F.sum("n").alias("pn"), F.sum("g").alias("pg")).where(F.col("c") >= CHILDREN)
    return shared.join_spread(rare, pools, at, hot, "inner").where(f"NOT ({DISTINCT})").select(*at, "child")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, parent, template, pages, n, g) of paths (host, path, pages, n, g): distinct paths with their labels n,
    g of them good. parent is the template without its last segment."""
    at = ["host", "node", "child"]
    state = shared.materialise(paths.select("*", segments(F.col("path")).alias("shape"), F.lit("").alias("parent"), F.lit("").alias("template")), "paths")
    for level in range(1, LEVELS + 1):
        here = state.withColumn("child", F.get("shape", F.lit(level - 1))).withColumnRenamed("template", "node")
        children = here.where("child IS NOT NULL").groupBy(*at).agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("g").alias("g"))
        children = shared.materialise(children, f"children-{level}")
        if not children.head(1):
            break
        wild = variable(children).withColumn("wild", F.lit(True))
        hot = shared.hot_keys(children.select(*at, F.col("paths").alias("n")), at)
        inner = shared.join_spread(here.where("child IS NOT NULL"), wild, at, hot)
        moved = inner.select("host", "path", "pages", "n", "g", "shape", F.col("node").alias("parent"), F.concat("node", F.lit("" if level == 1 else "/"), F.when(F.col("wild"), F.lit("{*}")).otherwise(F.col("child"))).alias("template"))
        done = here.where("child IS NULL").select("host", "path", "pages", "n", "g", "shape", "parent", F.col("node").alias("template"))
        state = shared.materialise(moved.unionByName(done), f"level-{level}")
    return state.drop("shape")


def purities(leaves: DataFrame) -> DataFrame:
    """(host, parent, template, purity, merged) from rows with host, parent, template, n labels and g good ones.

    purity is null where neither the template nor those merged with it have a label: nothing speaks against them."""
    at = ["host", "parent"]
    leaf = leaves.groupBy(*at, "template").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    pool = leaf.groupBy(*at).agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
    corpus = leaf.agg(F.sum("n").alias("cn"), F.sum("g").alias("cg"))
    hosts = leaf.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"))
    hosts = hosts.join(F.broadcast(corpus)).select("host", F.expr(f"(hg + {PRIOR} * coalesce(try_divide(cast(cg as double), cn), 1.0)) / (hn + {PRIOR})").alias("hp"))
    both = leaf.join(pool, at).select(*at, "template", "n", "g", F.expr(f"NOT ({DISTINCT})").alias("merged"))
    joint = both.where("merged").groupBy(*at).agg(F.sum("n").alias("mn"), F.sum("g").alias("mg"))
    out = both.join(joint, at, "left").join(hosts, "host")
    purity = F.when(F.col("merged"), F.when(F.col("mn") > 0, F.expr(f"(mg + {PRIOR} * hp) / (mn + {PRIOR})"))).otherwise(F.expr(f"(g + {PRIOR} * hp) / (n + {PRIOR})"))
    return out.select(*at, "template", purity.alias("purity"), "merged")


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each of pages: page_id, host, path, rule, template, purity, verdict (allow or block).

    labels: (page_id, good boolean); pages without a label count for the tree's shape only, and so do those with a null
    id. A null url, or one without ://, has an empty host and path and is judged as a host of its own. Repeated pages are
    judged alike, and their labels count as often; of repeated labels one bad makes the page bad. A purity at the limit
    is allowed. Segments that are {*} or {n} by themselves are taken for variables.
    """
    rules = RULES if rules is None else rules
    at = ["host", "path"]
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    marks = labels.select(F.col(labels.columns[0]).alias("page_id"), F.col(labels.columns[1]).alias("good")).where("good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    marked = rows.join(marks, "page_id").select(*at, F.lit(0).alias("pages"), F.lit(1).alias("n"), F.col("good").cast("int").alias("g"))
    paths = rows.select(*at, F.lit(1).alias("pages"), F.lit(0).alias("n"), F.lit(0).alias("g")).unionByName(marked).groupBy(*at).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    shaped = templates(paths)
    leaves = shaped.join(purities(shaped), ["host", "parent", "template"]).select(*at, "template", "purity")
    hot = shared.hot_keys(shaped.select(*at, F.col("pages").alias("n")), at)
    out = shared.join_spread(rows, leaves, at, hot, "inner").withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r, verdict in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", *at, "rule", "template", "purity", verdict.alias("verdict"))
