"""URL filter: explicit host/path rules, and a path-template tree for what no rule decides.

Built with DataFrame functions only. Urls that a rule decides are the labelled examples. Paths are
generalised per host into templates, level by level from the root: the values of a segment below the
same parent become the wildcard ``*`` when they look variable (digits, long hex) or when there are
many of them, mostly seen once.

Then siblings are merged, again level by level from the root. Branches of one parent with the same most
frequent child form a group; a branch is alike the group if its pages over child segments pass a
likelihood-ratio test against the group's pooled shares, and, where both it and the others of the
group have labelled pages, their blocked shares pass a two-sample test. Two or more alike branches with
enough pages each become one branch ``~`` (``~2`` and so on for further groups), whose subtrees are one
from there on. So the labels of one branch reach the branches merged with it, which no rule covers.

A template is rejected when the smoothed share of blocked examples among its labelled pages reaches
``purity``. Smoothing backs off through the tree: (blocked + prior * up) / (labelled + prior), where up is
the parent's estimate. A parent's estimate counts branches, not pages, since pages of one
branch are labelled alike: (sum of the blocked shares of its labelled branches + prior * up) / (number
of these branches + prior), and ``base_rate`` is what stands above a host.

Edge cases: a null url, or one without ``://``, has an empty host and path; a page without labelled pages
near it keeps an estimate near base_rate and is allowed; repeated rows are judged alike; an empty
table gives no rows; segments from ``levels`` on are generalised as one. Input columns named like the
added ones are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.common import fresh, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict", "template", "block_share")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; rules are (verdict, host, path)."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    tests = []
    for verdict, host, path in longest_first:
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        tests.append(F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*tests, nothing)


def shape(segment: Column) -> Column:
    """The segment with what looks variable in it replaced: long hex by {h}, digits by {n}."""
    hexless = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{h}")
    return F.regexp_replace(hexless, r"[0-9]+", "{n}")


def _generalise(paths: DataFrame, level: int, distinct: int, novelty: float) -> DataFrame:
    """Adds segment ``level`` to the template: ``*`` where the parent's children look variable."""
    seg = F.get("segments", F.lit(level))
    here = paths.withColumn("_seg", seg)
    children = here.where("_seg is not null").groupBy("host", "template", "_seg").agg(F.sum("n").alias("c"))
    parents = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("c").alias("total"))
    wild = parents.where((F.col("kinds") >= distinct) & (F.col("kinds") >= novelty * F.col("total")))
    wild = wild.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.lit(True).alias("_wild"))
    here = here.join(wild, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    name = F.when(F.col("_wild"), F.lit("*")).otherwise(F.col("_seg"))
    step = F.when(F.col("_seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
    names = F.when(F.col("_seg").isNull(), F.col("names")).otherwise(F.concat("names", F.array(name)))
    return here.withColumn("template", step).withColumn("names", names).drop("_seg", "_h", "_t", "_wild")


def _merge_alike(tree: DataFrame, level: int, alike_pages: int, strictness: float) -> DataFrame:
    """Adds a name for segment ``level`` to the merged path ``pre``: alike siblings get one."""
    here = tree.withColumn("branch", F.get("names", F.lit(level))).withColumn("child", F.coalesce(F.get("names", F.lit(level + 1)), F.lit("")))
    counts = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    kids = scratch(here.where("branch is not null").groupBy("host", "pre", "branch", "child").agg(*counts), f"kids{level}")
    sums = kids.groupBy("host", "pre", "branch").agg(F.max(F.struct("n", "child"))["child"].alias("lead"), *counts)
    able = sums.where((F.col("n") >= alike_pages) & (F.col("lead") != "") & (F.col("branch") != "*"))
    able = able.select("host", "pre", "branch", "lead", F.col("n").alias("total"), "blocked", "allowed")
    group = ["host", "pre", "lead"]
    of_kids = kids.select("host", "pre", "branch", "child", "n").join(able.select("host", "pre", "branch", "lead", "total"), ["host", "pre", "branch"])
    pool = of_kids.groupBy(*group, "child").agg(F.sum("n").alias("pooled"))
    sizes = able.groupBy(*group).agg(F.sum("total").alias("pages"), F.sum("blocked").alias("all_blocked"), F.sum("allowed").alias("all_allowed"))
    sizes = sizes.join(pool.groupBy(*group).agg((F.count("*") - 1).alias("free")), group)
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pooled") / F.col("pages"))))
    tested = of_kids.join(pool, [*group, "child"]).join(sizes, group).groupBy("host", "pre", "branch").agg((2 * gain).alias("gain"))
    judged = able.join(tested, ["host", "pre", "branch"]).join(sizes, group)
    own, others = F.col("blocked") + F.col("allowed"), F.col("all_blocked") + F.col("all_allowed") - F.col("blocked") - F.col("allowed")
    share = F.col("all_blocked") / (own + others)
    apart = F.col("blocked") / own - (F.col("all_blocked") - F.col("blocked")) / others
    unlike = (own > 0) & (others > 0) & (apart * apart > strictness**2 * share * (1 - share) * (1 / own + 1 / others))
    alike = judged.where((F.col("gain") <= F.col("free") + strictness * F.sqrt(2 * F.col("free")) + 1e-6) & ~F.coalesce(unlike, F.lit(False)))
    groups = alike.groupBy(*group).agg(F.count("*").alias("branches"), F.sum("total").alias("size")).where("branches > 1")
    place = F.row_number().over(Window.partitionBy("host", "pre").orderBy(F.col("size").desc(), "lead"))
    groups = groups.select(*group, F.when(place == 1, F.lit("~")).otherwise(F.concat(F.lit("~"), place)).alias("merged"))
    merged = scratch(alike.join(groups, group).select("host", "pre", "branch", "merged"), f"merged{level}")
    name = F.coalesce("merged", "branch")
    step = F.when(F.col("branch").isNull(), F.col("pre")).otherwise(F.concat("pre", F.lit("/"), name))
    out = here.join(merged, ["host", "pre", "branch"], "left")
    done = F.when(F.col("branch").isNull(), F.col("done")).otherwise(F.concat("done", F.array(name)))
    return out.select("host", "shaped", "n", "blocked", "allowed", "names", step.alias("pre"), done.alias("done"))


def path_templates(paths: DataFrame, levels: int = 6, distinct: int = 8, novelty: float = 0.3, alike_pages: int = 8, strictness: float = 3.0) -> DataFrame:
    """(host, shaped, n, blocked, allowed) with the template of each shaped path and its segments.

    paths has a row per host and shaped path, so the pages of one site with numbered articles are
    few rows here. Every level groups by host and parent with partial sums and joins the few variable
    parents, then the few merged branches, back; a host with a third of all paths is a skewed join, which
    adaptive execution splits.
    """
    segments = F.filter(F.split(F.col("shaped"), "/"), lambda s: s != "")
    head = F.slice(segments, 1, levels)
    rest = F.slice(segments, levels + 1, 1 << 20)
    whole = F.when(F.size(rest) > 0, F.concat(head, F.array(F.array_join(rest, "/")))).otherwise(head)
    tree = paths.withColumn("segments", whole).withColumn("template", F.lit("")).withColumn("names", F.array().cast("array<string>"))
    for level in range(levels + 1):
        tree = scratch(_generalise(tree, level, distinct, novelty), f"tree{level}")  # else a plan holds the one before twice
    tree = tree.select("host", "shaped", "n", "blocked", "allowed", "names", F.lit("").alias("pre"), F.array().cast("array<string>").alias("done"))
    for level in range(levels + 1):
        tree = scratch(_merge_alike(tree, level, alike_pages, strictness), f"alike{level}")
    return tree.select("host", "shaped", "n", "blocked", "allowed", F.col("pre").alias("template"), F.col("done").alias("segments"))


def block_shares(templates: DataFrame, prior: float, base_rate: float) -> DataFrame:
    """(host, template, block_share), smoothed by the estimates of the nodes above the template."""
    sums = [F.sum(c).alias(c) for c in ("blocked", "allowed")]
    own = scratch(templates.groupBy("host", "template").agg(F.first("segments").alias("segments"), *sums), "shares")
    above = F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.array_join(F.slice("segments", 1, k - 1), "/"))
    above = F.when(F.size("segments") > 0, above).otherwise(F.array().cast("array<string>"))
    steps = own.select("host", "template", "segments", "blocked", "allowed", F.posexplode(above).alias("depth", "node"))
    labelled = steps.where("blocked + allowed > 0").groupBy("host", "node", F.get("segments", F.col("depth")).alias("branch")).agg(*sums)
    shares = labelled.groupBy("host", "node").agg(F.sum(F.col("blocked") / (F.col("blocked") + F.col("allowed"))).alias("bad"), F.count("*").alias("branches"))
    chain = F.sort_array(F.collect_list(F.struct("depth", "bad", "branches")))  # of at most levels + 1
    chains = steps.select("host", "template", "depth", "node").join(shares, ["host", "node"]).groupBy("host", "template").agg(chain.alias("chain"))
    up = F.aggregate("chain", F.lit(float(base_rate)), lambda acc, x: (x["bad"] + prior * acc) / (x["branches"] + prior))
    out = own.join(chains, ["host", "template"], "left").withColumn("up", F.coalesce(up, F.lit(float(base_rate))))
    return out.select("host", "template", ((F.col("blocked") + prior * F.col("up")) / (F.col("blocked") + F.col("allowed") + prior)).alias("block_share"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    purity: float = 0.6,
    prior: float = 4.0,
    base_rate: float = 0.1,
    label: str | None = None,
    **tree,
) -> DataFrame:
    """pages with host, path, rule, verdict, template and block_share (the last two null under a rule).

    label names a column that is 1 for pages known to be bad, 0 for good ones, else null; with it,
    pages that no rule decides are examples too.
    """
    rule, shaped, of_host, of_shape, template, share = fresh("rule", "shaped", "host", "shape", "template", "share")
    kept = [c for c in pages.columns if c not in ADDED]
    urls = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    urls = urls.withColumn(rule, matching_rule(rules)).withColumn(shaped, shape(F.col("path")))
    known = F.when(F.col(label) == 1, "block").when(F.col(label) == 0, "allow") if label else F.lit(None)
    example = F.coalesce(F.col(rule)["verdict"], known, F.lit(""))
    blocked, allowed = (F.sum((example == v).cast("long")) for v in ("block", "allow"))
    counted = urls.groupBy("host", F.col(shaped).alias("shaped"))
    paths = counted.agg(F.count("*").alias("n"), blocked.alias("blocked"), allowed.alias("allowed"))
    templates = scratch(path_templates(scratch(paths, "paths"), **tree), "templates")
    known = templates.select("host", "shaped", "template").join(block_shares(templates, prior, base_rate), ["host", "template"])
    known = known.select(F.col("host").alias(of_host), F.col("shaped").alias(of_shape), F.col("template").alias(template), F.col("block_share").alias(share))
    judged = urls.join(known, (F.col("host") == F.col(of_host)) & (F.col(shaped) == F.col(of_shape)), "left")
    unruled = F.col(rule).isNull()
    method = F.when(F.coalesce(share, F.lit(0.0)) >= purity, "block").otherwise("allow")
    return judged.select(
        *kept, "host", "path", F.col(rule)["rule"].alias("rule"), F.coalesce(F.col(rule)["verdict"], method).alias("verdict"),
        F.when(unruled, F.col(template)).alias("template"), F.when(unruled, F.col(share)).alias("block_share"),
    )
