"""URL filters: rules first, then a path-template tree with smoothed labelled purity.

Every url gets a host and a path. Rules of the form (host, path prefix) fit the host and
its subdomains; the longest fitting rule decides. For urls without a rule a tree of path
templates is learnt per host:

1. lexical wildcards: digits and hexadecimal ids in a segment become ``<n>`` / ``<h>``;
2. statistical wildcards: below one parent, if distinct segments are more than
   ``spread`` of the urls there (and at least ``min_children``), all become ``<*>``;
3. branches of one parent whose labelled rates do not differ from the pooled rate by
   more than ``z`` standard errors are merged into ``<~>``;
4. a template is rejected if its smoothed labelled purity is at least ``reject``. Hosts with
   few labels lean on others: the purity of a shape (the path after step 1) over all hosts is
   smoothed towards ``prior_rate``, that over a top-level domain towards the one over all,
   that over a domain (two last labels) towards its top-level domain's, each by ``prior``
   pseudo-labels; a template starts from the mean of its shapes, by number of urls.

Labels are given by the caller; in the query they are the verdicts of the rules.

Scale: after step 1 everything runs on counts per (host, shape), pre-aggregated before
the shuffle, so a host with a third of all pages is a handful of rows. Levels are worked off
while any parent still has several paths below it, at most ``depth`` (a parameter; segments
beyond it stay as step 1 left them). Only the verdict table is joined back, on (host, shape).

Defined cases: a null url or one without ``://`` has empty host and path and is a template
of its own; urls of any length and depth are judged as a whole; repeated rows each get their
verdict; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, materialize

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEPTH = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.locate("://", url)
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, else nulls."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    pick = lambda values: reduce(lambda c, x: c.when(*x), zip(fits[1:], values[1:]), F.when(fits[0], values[0]))
    return pick([F.lit(h + p) for _, h, p in ranked]), pick([F.lit(v) for v, _, _ in ranked])


def lexical_template(path: Column) -> Column:
    """Segments of a path with ids replaced."""
    path = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9A-Za-z])", "<h>")
    parts = F.split(F.regexp_replace(path, r"[0-9]+", "<n>"), "/")
    return F.slice(parts, 2, 1_000_000)


def _smoothed(blocked: Column, labelled: Column, before: Column, prior: float) -> Column:
    return (F.coalesce(blocked, F.lit(0)) + F.lit(prior) * before) / (F.coalesce(labelled, F.lit(0)) + F.lit(prior))


def pooled_purity(counts: DataFrame, prior: float, prior_rate: float) -> DataFrame:
    """counts: host, parts, labelled, blocked, ... with ``base``: the purity of the shape in the domain, backed off."""
    labels = F.split("host", r"\.", -1)
    wide = counts.withColumns({"tld": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")})
    base: Column = F.lit(prior_rate)
    for name, keys in (("all", ["parts"]), ("tld", ["parts", "tld"]), ("dom", ["parts", "domain"])):
        sums = wide.where("labelled > 0").groupBy(*keys).agg(F.sum("labelled").alias(f"l_{name}"), F.sum("blocked").alias(f"b_{name}"))
        wide = wide.join(sums, keys, "left")
        base = _smoothed(F.col(f"b_{name}"), F.col(f"l_{name}"), base, prior)
    return wide.select(*counts.columns, base.alias("base"))


def _named(kids: DataFrame, spread: float, min_children: int, z: float) -> DataFrame:
    """host, node, kid, to: the name under which each branch goes on."""
    stats = kids.groupBy("host", "node").agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n").alias("n_all"),
        F.sum("labelled").alias("l_all"), F.sum("blocked").alias("b_all"),
    )
    wild = (F.col("kids") >= min_children) & (F.col("kids") > spread * F.col("n_all"))
    rate = F.col("b_all") / F.col("l_all")
    error = F.sqrt(rate * (1 - rate) / F.col("labelled") + F.lit(1e-12))
    alike = (F.col("kids") > 1) & (F.col("labelled") > 0) & (F.abs(F.col("blocked") / F.col("labelled") - rate) <= z * error)
    # the pooled rate says something only where other branches were labelled too
    alike = alike & (F.col("l_all") > F.col("labelled"))
    name = F.when(wild, F.lit("<*>")).when(F.coalesce(alike, F.lit(False)), F.lit("<~>")).otherwise(F.col("kid"))
    return kids.join(stats, ["host", "node"]).select("host", "node", "kid", name.alias("to"))


def template_verdicts(
    counts: DataFrame, spread: float = 0.5, min_children: int = 20, z: float = 2.0,
    prior: float = 4.0, prior_rate: float = 0.2, reject: float = 0.6, depth: int = DEPTH,
) -> DataFrame:
    """counts: host, parts (array), n, labelled, blocked -> host, parts, template, purity, made."""
    tree = materialize(pooled_purity(counts, prior, prior_rate).withColumn("node", F.array().cast("array<string>")))
    done = None
    for k in range(1, depth + 1):
        # a parent with one path below it has nothing to generalise
        several = tree.groupBy("host", "node").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").drop("paths")
        rest = F.concat("node", F.when(F.size("parts") >= k, F.slice("parts", k, 1_000_000)).otherwise(F.array().cast("array<string>")))
        ended = tree.join(several, ["host", "node"], "left_anti").withColumn("node", rest)
        done = ended if done is None else done.unionByName(ended)
        open_ = tree.join(several, ["host", "node"], "left_semi").withColumn("kid", F.coalesce(F.get("parts", F.lit(k - 1)), F.lit("")))
        kids = open_.groupBy("host", "node", "kid").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        open_ = open_.join(_named(kids, spread, min_children, z), ["host", "node", "kid"])
        tree = materialize(open_.withColumn("node", F.when(F.size("parts") >= k, F.concat("node", F.array("to"))).otherwise(F.col("node"))).drop("kid", "to"))
        # paths that have ended leave the tree with the name they got
        ended = tree.where(F.size("parts") <= k)
        done, tree = done.unionByName(ended), tree.where(F.size("parts") > k)
        if not tree.take(1):
            break
    done = done.unionByName(tree.withColumn("node", F.concat("node", F.slice("parts", depth + 1, 1_000_000)))) if depth else tree.withColumn("node", F.col("parts"))
    tree = done.withColumn("template", F.array_join("node", "/"))
    totals = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), (F.sum(F.col("base") * F.col("n")) / F.sum("n")).alias("start"))
    totals = totals.withColumn("purity", _smoothed(F.col("b"), F.col("l"), F.col("start"), prior))
    totals = totals.withColumn("made", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return tree.select("host", "parts", "template").join(totals, ["host", "template"]).select("host", "parts", "template", "purity", "made")


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and by_rule (its verdict); null where none fits."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "by_rule": verdict})


def filter_urls(pages: DataFrame, rules=RULES, **tree) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    rows = with_rules(pages, rules).withColumn("parts", lexical_template(F.col("path")))
    counts = rows.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked")
    )
    made = materialize(template_verdicts(materialize(counts), **tree))
    out = rows.join(made, ["host", "parts"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "made").alias("verdict"), "template", "purity")
