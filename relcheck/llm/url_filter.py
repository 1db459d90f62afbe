"""URL rules by host-suffix and path-prefix expressions, in Spark SQL functions only.

Each URL is expanded into the expressions that a rule could have (every suffix of its host at a dot,
every prefix of its path that is as long as some rule's path). Expressions and rules meet in an
equi-join on the first eight hex digits of their SHA-256; the full digest and the text confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ://."""
    parts = [F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2)]
    return F.translate(parts[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), parts[1]


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = 100_000, salts: int = 32) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    rules: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with
    the rule's; the longest rule (host and path) wins, and between rules of equal text "block". URLs
    that no rule fits get `default`. Null URLs have empty host and path; null and repeated page_ids
    keep one row each; rules with a null are no rules; without rules or pages nothing fails.
    Up to `broadcast_rules` rules are broadcast; more are joined by shuffle, where each rule stands
    once for each salt, so that an expression that a third of all URLs have is shared by many tasks.
    """
    rule = F.concat("host", "path")
    known = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(F.col("path").alias("rule_path"), rule.alias("rule"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"))
    facts = known.agg(F.count("*"), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    lengths = F.array(*(F.lit(n) for n in facts[1])) if facts[1] else F.array().cast("array<int>")

    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    wide = base.select("*", F.explode_outer(expressions).alias("expression")).withColumn("sha", F.sha2("expression", 256))
    wide = wide.withColumn("short", F.substring("sha", 1, 8)).drop("expression")
    known = known.withColumn("short", F.substring("digest", 1, 8))
    if facts[0] <= broadcast_rules:
        met = wide.join(F.broadcast(known), "short", "left")
    else:
        wide = wide.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = wide.join(known, ["short", "salt"], "left")
    best = F.when(F.col("sha") == F.col("digest"), F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule")))
    # rows of one page come from one task, so this combines before the shuffle to one row a page
    judged = met.groupBy("row", "page_id", "host", "path").agg(F.max(best).alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
