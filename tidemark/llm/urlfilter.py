"""URL filters by expressions: host suffixes times path prefixes.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's path. Of several fitting rules the longest (host
and path together) wins, then the longest host, then block over allow.

Defined cases: a null url, or one without "://", has an empty host and path and
no rule; rules with a null host, path or verdict are left out; repeated rules
count once; an empty rule table gives the default everywhere; other columns pass
through, and columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh
from tidemark.plans.lineage import small, written


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", prefix_hex: int = 8, broadcast_rules: int = 500_000) -> DataFrame:
    """Add host, path, rule (null if none) and verdict.

    A url is expanded into its host suffixes and path prefixes of the shapes (labels,
    characters) that some rule has; these pairs of small numbers are all that the driver
    gathers. Expressions meet rules in an equi-join on the first `prefix_hex` digits of
    their SHA-256 alone; what meets is then confirmed by the full digests. Each distinct
    (host, path) is looked up once, so a hot url or rule does not gather rows in one task.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    shapes = [(r.labels, r.chars) for r in rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().toLocalIterator()]
    named = dict(zip(("host", "path"), (url_host(F.col(url_col)), url_path(F.col(url_col)))))
    judged = pages.withColumns(named)
    found = judged.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    known_shapes = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(m).alias("chars")) for n, m in sorted(shapes))) if shapes else F.array().cast("array<struct<labels:int,chars:int>>")
    fitting = F.filter(known_shapes, lambda s: (s["labels"] <= F.size("labels")) & (s["chars"] <= F.length("path")))
    found = found.select("host", "path", "labels", F.explode(fitting).alias("shape"))
    suffix = F.array_join(F.slice("labels", F.size("labels") - F.col("shape.labels") + 1, F.col("shape.labels")), ".")
    prefix = F.substring(F.col("path"), F.lit(1), F.col("shape.chars"))
    found = found.select("host", "path", F.sha2(F.concat_ws("\n", suffix, prefix), 256).alias("digest"))
    key = lambda c: F.substring(c, 1, prefix_hex)
    known = small(written(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", F.col("digest").alias("rule_digest"), key("digest").alias("rule_key")), "rules"), broadcast_rules)
    hits = found.withColumn("key", key("digest")).join(known, F.col("key") == F.col("rule_key"))
    # Not an equality, so that it stays a test of the rows that the short prefix brings together.
    hits = hits.where(F.startswith("digest", "rule_digest"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    (name,) = fresh(judged, "best")
    best = small(written(best, "best-rules"), broadcast_rules).withColumnRenamed("best", name)
    out = judged.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(f"{name}.verdict", F.lit(default))}).drop(name)
