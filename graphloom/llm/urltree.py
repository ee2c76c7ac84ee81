"""URL filtering: explicit rules first, else a path-template tree judged by labelled purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Rules are a parameter, not data."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def templates(urls: DataFrame, min_support: int) -> DataFrame:
    """urls (id, host, path, ...) with the column template, an array: per host, segments seldom seen at their place become *.

    The tree grows level by level, as deep as the paths are. A segment stays literal if at least
    min_support urls have it below the same node; all others share the node's wildcard. Below
    nodes with fewer urls are wildcards alone, so the tree is done where no other node is left.
    """
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    left = urls.withColumn("segs", segs).withColumn("template", F.array().cast("array<string>"))
    kept, level, done = urls.columns, 0, []
    while True:
        level += 1
        own = left.where(F.size("segs") >= level).withColumn("seg", F.get("segs", F.lit(level - 1)))
        seen = checkpoint(own.groupBy("host", "template", "seg").agg(F.count("*").alias("n")))
        if not seen.groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support).take(1):
            rest = F.concat("template", F.array_repeat(F.lit("*"), F.greatest(F.size("segs") - (level - 1), F.lit(0))))
            done.append(left.select(*kept, rest.alias("template")))
            return checkpoint(reduce(DataFrame.unionByName, done))
        done.append(left.where(F.size("segs") < level).select(*kept, "template"))
        literal = seen.where(F.col("n") >= min_support).select("host", "template", "seg", F.lit(True).alias("literal"))
        grown = salted_join(own, literal, ["host", "template", "seg"], "id", "left")
        left = checkpoint(grown.withColumn("template", F.concat("template", F.array(F.when(F.col("literal"), F.col("seg")).otherwise("*")))).drop("seg", "literal"))


def merged(branches: DataFrame, merge_z: float) -> DataFrame:
    """branches (host, template, n, bad) with `final`, the template that each ends in.

    From the deepest level up to the first, labelled siblings (two or more templates that differ
    in that segment alone) merge into the one with a wildcard there, if their share of bad pages
    is within merge_z standard errors of the share of all these siblings. A branch without
    labelled pages is like no other and stays; what merged is one branch on the next level.
    """
    now = branches.withColumn("final", F.col("template"))
    for k in range(now.agg(F.max(F.size("final"))).first()[0] or 0, 0, -1):
        wild = F.concat(F.slice("final", 1, k - 1), F.array(F.lit("*")), F.slice("final", k + 1, F.greatest(F.size("final") - k, F.lit(0))))
        own = now.groupBy("host", "final").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.size("final") >= k).withColumn("parent", wild)
        own = own.where("n > 0")
        common = own.groupBy("host", "parent").agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("common"), F.count("*").alias("siblings")).where("siblings > 1")
        near = F.abs(F.col("bad") / F.col("n") - F.col("common")) <= merge_z * F.sqrt(F.col("common") * (1 - F.col("common")) / F.col("n"))
        if not common.take(1):
            continue
        alike = own.join(common, ["host", "parent"]).where(near).select("host", "final", "parent")
        now = checkpoint(now.join(alike, ["host", "final"], "left").withColumn("final", F.coalesce("parent", "final")).drop("parent"))
    return now


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    labels: DataFrame | None = None,
    min_support: int = 10,
    merge_z: float = 1.96,
    prior_weight: float = 10.0,
    reject_above: float = 0.5,
    reject_z: float = 1.96,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "page_id",
    good_col: str = "good",
) -> DataFrame:
    """(id, host, path, rule, verdict, template, bad_share) for every row of pages.

    verdict is the longest fitting rule's (a rule fits its host and all subdomains if the path
    starts with the rule's), else the template tree's: urls are counted into templates per host
    (templates), statistically similar sibling branches merge on every level (merged), and a
    template is blocked if most of its labelled pages are bad and their share, smoothed by
    prior_weight pages of the overall share, is above reject_above by reject_z standard errors: a template of a few
    labelled pages, or one in which good and bad ones mix, is allowed.

    labels gives some pages a 1 (good) or 0 (bad); the smallest of several counts; the others are unlabelled. Without labels the
    rules label every page: what they block is bad, all else good. So the tree carries a block to urls of the same shape
    only where the shape as a whole is blocked, and a branch that no rule names stays allowed however few pages it has.

    All is counted by aggregation and joined by salted joins, so a host or template with a third
    of all urls is spread over tasks. A null url, or one without "://", has host and path ''. A page without a label,
    or with a null one, counts for support alone; without any labelled page nothing is blocked but
    by rules. Paths may have any depth. Repeated rows count each time. Only the named columns are
    read; no pages give no rows.
    """
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = longest_rule(rules)
    if labels is None:
        own = own.withColumn("good", F.when(ruled["verdict"] == "block", 0).otherwise(1))
    else:
        marks = labels.where(F.col(label_id).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.min(good_col).cast("int").alias("good"))
        own = own.join(marks, "id", "left")
    rows = templates(own, min_support)
    branches = merged(rows.groupBy("host", "template").agg(F.count("good").alias("n"), F.coalesce(F.sum(1 - F.col("good")), F.lit(0)).alias("bad")), merge_z)
    whole = branches.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = whole["bad"] / whole["n"] if whole["n"] else 0.0
    sums = branches.groupBy("host", "final").agg(F.sum("n").alias("n_f"), F.sum("bad").alias("bad_f"))
    share = (F.col("bad_f") + prior_weight * prior) / (F.col("n_f") + prior_weight)
    judged = salted_join(branches.select("host", "template", "final"), sums, ["host", "final"], "template").select("host", "template", "final", "n_f", "bad_f", share.alias("bad_share"))
    out = salted_join(rows, judged, ["host", "template"], "id").withColumn("own", ruled)
    error = F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("n_f") + prior_weight))
    reject = (F.col("bad_f") * 2 > F.col("n_f")) & (F.col("bad_share") - reject_z * error > reject_above)
    verdict = F.coalesce("own.verdict", F.when(reject, "block").otherwise("allow"))
    name = F.concat_ws("", F.transform("final", lambda s: F.concat(F.lit("/"), s)))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), name.alias("template"), "bad_share")
