"""URL filter: host and path rules, then a path-template tree for each host.

Host: what follows the first :// up to /, ? , # or the end, A-Z lowered; path: from there up to ?, # or the
end; without :// both are empty. A rule is a host and a path prefix; it fits the host and its
subdomains if the path starts with the prefix, and the longest one that fits decides.

Template tree. A path's segments hang below their host. A segment with a digit is a wildcard, and so are all
children of a node with more than `most_branches` different ones, from the top down, whatever the depth. So each page
has a template. Branches of a node (templates that differ in their last literal segment only) are
merged with their labelled siblings if their share of blocked pages is not apart from that of all siblings
together by more than `apart` standard errors; a merged branch has the counts of all that
merged. A template is rejected if its purity, the share of blocked among labelled pages smoothed by `smoothing`
pages of the global share (or of one half, if that is less), is `reject_at` or more; so a template without labels is allowed. Labels
are given for some pages (`label_col`); a page without one has the verdict of its rule, if any, as its label.

Paths are counted by host and masked segments before the tree is built, so a hot host
is a few rows there. In each turn every path is opened at its topmost wide node; there are as many turns as wide nodes
lie above each other. Cases: a null url, or one without ://, has empty host and path, no rule and the template of an empty path;
repeated rows are judged alike, and each counts; other values than block and allow are no labels; an empty table gives no rows; other
columns are not read. A path may have any number of segments (the work for one of n is n * n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.session import materialize

WILD = "*"

#: Fixed rules of the query: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(the rule's text, its verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def masked_segments(path: Column) -> Column:
    parts = F.array_remove(F.split(path, "/"), "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit(WILD)).otherwise(s))


def template_tree(paths: DataFrame, most_branches: int) -> DataFrame:
    """Rows (host, segments) with their template: wide nodes become wildcards from the top down."""
    tree = paths.select("host", "segments", F.col("segments").alias("template"))
    step = lambda k: F.struct(k.alias("level"), F.xxhash64(F.slice("template", F.lit(1), k)).alias("node"), F.get("template", k).alias("segment"))
    while True:
        steps = F.transform(F.sequence(F.lit(0), F.size("template") - 1), step)
        nodes = tree.where(F.size("template") > 0).select("host", "segments", F.explode(steps).alias("s")).select("host", "segments", "s.*")
        wide = nodes.select("host", "level", "node", "segment").distinct().groupBy("host", "level", "node").agg(F.count("*").alias("n"))
        wide = materialize(wide.where(F.col("n") > most_branches).select("host", "level", "node"), "wide")
        if wide.limit(1).count() == 0:
            return tree
        top = nodes.join(wide, ["host", "level", "node"], "left_semi").groupBy("host", "segments").agg(F.min("level").alias("top"))
        opened = F.transform("template", lambda s, k: F.when(k == F.col("top"), F.lit(WILD)).otherwise(s))
        tree = tree.join(top, ["host", "segments"], "left").select("host", "segments", F.when(F.col("top").isNull(), F.col("template")).otherwise(opened).alias("template"))
        tree = materialize(tree, "tree")


def template_purity(paths: DataFrame, most_branches: int, apart: float, smoothing: float) -> DataFrame:
    """(host, segments, template, purity) of rows (host, segments, n, n_labelled, n_blocked)."""
    tree = template_tree(paths, most_branches).join(paths, ["host", "segments"])
    total = paths.agg(F.coalesce(F.sum("n_labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_blocked"), F.lit(0)).alias("k")).first()
    prior = min(0.5, (total["k"] + 0.5) / (total["n"] + 1.0))
    nodes = tree.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_blocked").alias("k"))
    # siblings: alike but for the last literal segment
    last = F.array_max(F.transform("template", lambda s, i: F.when(s != WILD, i).otherwise(F.lit(-1))))
    family = F.transform("template", lambda s, i: F.when(i == F.col("last"), F.lit(None).cast("string")).otherwise(s))
    nodes = materialize(nodes.withColumn("last", last).withColumn("family", family).drop("last"), "nodes")
    pooled = nodes.where("n > 0").groupBy("host", "family").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    both = nodes.join(pooled, ["host", "family"], "left")
    share = F.col("all_k") / F.col("all_n")
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / F.col("n"))
    alike = (F.col("n") > 0) & (F.abs(F.col("k") / F.greatest(F.col("n"), F.lit(1)) - share) <= apart * error)
    both = both.withColumn("alike", F.coalesce(alike, F.lit(False)))
    merged = both.where("alike").groupBy("host", "family").agg(F.sum("n").alias("m_n"), F.sum("k").alias("m_k"))
    both = both.join(merged, ["host", "family"], "left")
    n, k = (F.when(F.col("alike"), F.col("m_" + c)).otherwise(F.col(c)) for c in ("n", "k"))
    purity = (k + smoothing * prior) / (n + smoothing)
    return tree.select("host", "segments", "template").join(both.select("host", "template", purity.alias("purity")), ["host", "template"])


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
    rules: tuple = RULES,
    most_branches: int = 24,
    apart: float = 2.0,
    smoothing: float = 4.0,
    reject_at: float = 0.7,
) -> DataFrame:
    """One row for each page: id, host, path, rule, template, purity, verdict.

    label_col, if given, holds 'block' or 'allow' for some pages; the rules' verdicts are the labels of the others.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), *([F.col(label_col).alias("given")] if label_col else []))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says, "segments": masked_segments(F.col("path"))})
    label = F.coalesce(F.when(F.col("given").isin("block", "allow"), F.col("given")), F.col("says")) if label_col else F.col("says")
    counts = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count(label).alias("n_labelled"), F.count_if(label == "block").alias("n_blocked"))
    purity = materialize(template_purity(materialize(counts, "paths"), most_branches, apart, smoothing), "purity")
    judged = rows.join(purity, ["host", "segments"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", verdict.alias("verdict"))
