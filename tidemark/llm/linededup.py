"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages;
lines above `max_ratio`, on at least `min_pages` pages, are boilerplate and are
dropped from that host's pages. Lines end at "\\n" and are compared as they are.

Defined cases: a null text stays null, an empty text is one empty line; empty
lines are never boilerplate; a line counts once a page; pages without a host
form one group of their own; repeated rows are pages of their own; a page that
loses all lines has an empty text; other columns pass through, and columns named
n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.plans.lineage import small, written

#: A line on one page in twenty of a site, on 3 pages at least, is taken for part of its template: template lines
#: stand on a share of the pages that does not fall as the site grows, text of a page's own only on that page's
#: copies. A tenth would cut through the lines that stand on about a tenth of all pages, by sampling noise.
MAX_RATIO, MIN_PAGES = 0.05, 3


def boilerplate_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the MD5 digests of its boilerplate lines: (host, digests array<string>).

    Only a host and 16 bytes a line are shuffled, after partial counts. A host's
    array has at most (its mean number of distinct lines a page) / max_ratio entries.
    """
    host = F.struct(F.col(host_col)).alias("host")
    plain = docs.select(host, F.col(text_col).alias("text"))
    totals = plain.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = plain.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    counts = lines.select("host", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages")).groupBy("host").agg(F.collect_list(F.lower(F.hex("digest"))).alias("digests"))


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_hosts: int = 10_000) -> DataFrame:
    """Replace the text by its kept lines; add n_lines and n_dropped.

    The hosts' arrays are written first. They are broadcast up to `broadcast_hosts`
    hosts and 64 MB; beyond that pages and arrays meet by a shuffle on the host, which
    adaptive execution splits for a hot host. A page's lines and its host's array are
    intersected by hashing; most pages have no line in common and stay as they are.
    """
    found = small(written(boilerplate_lines(docs, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages), "boilerplate"), broadcast_hosts)
    site, digests, lines, own, hits, kept = fresh(docs, "site", "digests", "lines", "own", "hits", "kept")
    joined = docs.join(found.toDF(site, digests), F.struct(docs[host_col].alias(host_col)) == F.col(site), "left")
    joined = joined.withColumn(lines, F.split(text_col, "\n"))
    joined = joined.withColumn(own, F.when(F.col(digests).isNotNull(), F.transform(lines, lambda line: F.md5(line.cast("binary")))))
    joined = joined.withColumn(hits, F.array_intersect(own, digests))
    rest = F.filter(lines, lambda line, i: ~F.array_contains(F.col(hits), F.element_at(own, i + 1)))
    joined = joined.withColumn(kept, F.when(F.size(F.coalesce(hits, F.array().cast("array<string>"))) == 0, F.col(lines)).otherwise(rest))
    count = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": count(lines), "n_dropped": count(lines) - count(kept), text_col: F.array_join(kept, "\n")}).drop(site, digests, lines, own, hits, kept)
