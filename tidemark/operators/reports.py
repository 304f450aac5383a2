"""Report tables: counts, roll-ups and renumbered issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.entity import parent_clusters, parent_pairs
from tidemark.plans.numbering import in_sequence


def audit_summary(issues: DataFrame) -> DataFrame:
    """(service, errors, warnings, fixed, total) and a TOTAL row, from one roll-up."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = issues.rollup("service").agg(F.grouping("service").alias("_all"), count("ERROR").alias("errors"), count("WARNING").alias("warnings"), count("FIXED").alias("fixed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("service", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("service"))).drop("_all")


def in_report_order(summary: DataFrame) -> DataFrame:
    """Add place: by name in any case, Unknown last but for TOTAL. The window runs over one row a service."""
    order = [F.when(F.col("service") == "TOTAL", 2).when(F.col("service") == "Unknown", 1).otherwise(0), F.lower("service"), F.col("service")]
    return summary.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("place")


def tagged_summary(issues: DataFrame, tags: tuple[str, ...] = ("duplicate_parent_email", "redundant_ec")) -> DataFrame:
    """Per service the counts of issues with tags that go to clients, and TOTAL."""
    out = issues.where(F.col("tag").isin(*tags)).rollup("service").agg(F.grouping("service").alias("_all"), *(F.count_if(F.col("tag") == t).alias(t) for t in tags))
    return out.withColumn("service", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("service"))).drop("_all")


def client_issues(fixed: DataFrame, split: DataFrame, tags: tuple[str, ...] = ("duplicate_parent_email", "redundant_ec")) -> DataFrame:
    """The issues that go to clients, with service and the row's number in that service's file."""
    return renumbered(fixed.where(F.col("tag").isin(*tags)), split)


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """(field, severity, n, place), the most frequent first; the window runs over the few groups."""
    counts = issues.groupBy("field", "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "field", "severity")).cast("long"))


def renumbered(issues: DataFrame, split: DataFrame) -> DataFrame:
    """Issues with the service and the row's number in that service's file."""
    return issues.join(split.select("row_num", "service", "split_row"), "row_num", "left").withColumn("service", F.coalesce("service", F.lit("Unknown")))


def filtered(issues: DataFrame, severity: str | None = None, field: str | None = None, row_num: int | None = None, child_name: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("field", field), ("row_num", row_num), ("child_name", child_name)):
        if value is not None:
            issues = issues.where(F.col(name) == value)
    return issues


def filter_options(issues: DataFrame, columns: tuple[str, ...] = ("severity", "field")) -> DataFrame:
    """(option, value): the distinct values by which issues can be filtered, in order."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in columns)))
    return issues.select(each.alias("o")).select("o.*").distinct().orderBy("option", "value")


def with_split_rows(issues: DataFrame, split: DataFrame, related: str = "related_rows") -> DataFrame:
    """Issues whose related row numbers are those of the split files, as an array and as the text "rows 2, 5"; unknown rows keep theirs."""
    each = issues.withColumn("_issue", F.struct("row_num", "field")).select("_issue", F.posexplode(related).alias("_place", "_row"))
    named = each.join(split.select(F.col("row_num").alias("_row"), "split_row"), "_row", "left").withColumn("n", F.coalesce("split_row", "_row").cast("long"))
    lists = named.groupBy("_issue").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "n"))), lambda x: x["n"]).alias("split_related"))
    out = issues.join(lists.select("_issue.*", "split_related"), ["row_num", "field"], "left")
    shown = F.array_join(F.transform("split_related", lambda n: n.cast("string")), ", ")
    return out.withColumn("related_text", F.concat(F.lit("rows "), shown))


def booking_metrics(template: DataFrame) -> DataFrame:
    return template.groupBy("week_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("service_id").alias("services"), F.count_if(F.col("service_id") == "").alias("unmapped"))


def bookings_run(seen: dict[str, int], unmapped: DataFrame, conflicts: DataFrame, n_files: int = 1) -> DataFrame:
    """(metric, n): what a bookings run has read, found, removed and kept.

    seen: the counts that the run's stages have observed while they wrote their tables:
    template_rows, duplicate_rows, duplicate_groups, duplicates_removed, recurring_kept,
    recurring_files, casual_kept, casual_files and casual_removed. The rows read are the
    template's and the duplicates taken out before it. conflicts: the removed recurring
    bookings (service_id, child_id), whose distinct pairs are the conflict groups.
    """
    known = {"input_files": n_files, "raw_rows": seen["template_rows"] + seen["duplicates_removed"]} | {k: n for k, n in seen.items() if k != "template_rows"}
    out = unmapped.sparkSession.createDataFrame(list(known.items()), "metric string, n long")
    rows = F.count(F.lit(1))
    for df, what in ((unmapped, {"unmapped_services": rows}), (conflicts, {"conflict_rows": rows, "conflict_groups": F.count_distinct("service_id", "child_id")})):
        one = df.agg(*(c.alias(k) for k, c in what.items()))
        out = out.unionByName(one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("n")) for k in what))).alias("m")).select("m.*"))
    return out


def balances_run(resolved: DataFrame, skipped: DataFrame) -> DataFrame:
    """(outputs, rows, skipped): centres written, their rows, and centres that the map does not know."""
    return resolved.agg(F.count_distinct("centre").alias("outputs"), F.count(F.lit(1)).alias("rows")).join(skipped.agg(F.count(F.lit(1)).alias("skipped")), how="cross")


def duplicate_parents(profiles: DataFrame) -> DataFrame:
    """(ord, matched_on, parent_name, service) of the profiles in a duplicate pair."""
    pairs = parent_pairs(profiles)
    members = pairs.select(F.explode(F.array("a", "b")).alias("ord"), F.col("contact").alias("matched_on")).distinct()
    return members.join(profiles, "ord").select("ord", "matched_on", F.concat_ws(" ", "first", "last").alias("parent_name"), "service")


def duplicate_parent_report(profiles: DataFrame, cross: DataFrame | None = None, service_names: DataFrame | None = None) -> DataFrame:
    """(seq, Service_Name, Parent_Legacy_ID, Parent_Name, Matched_On, Parent_CRN, Parent_Slot, Linked_Child): a row an occurrence.

    Clusters of profiles that have at least two base ids come with one Matched_On each: the
    birth date, and the least phone that two members have. `cross` (row_num, slot, details)
    adds the matches across services. Blank service names come from `service_names`
    (service, mapped). Rows are numbered by Parent_Name, then Service_Name; of equal ones
    clusters come first, in order of their first member, then service and child.
    """
    rows = profiles
    if service_names is not None:
        rows = rows.join(service_names, "service", "left").withColumn("service_name", F.coalesce(F.nullif("service_name", F.lit("")), "mapped", "service")).drop("mapped")
    clusters = parent_clusters(profiles).select("ord", "cluster")
    member = rows.join(clusters, "ord")
    phones = member.select("cluster", F.explode("contacts").alias("contact")).groupBy("cluster", "contact").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("cluster").agg(F.min("contact").alias("contact"))
    births = member.groupBy("cluster").agg(F.min_by("birth", "ord").alias("birth"))
    matched = births.join(phones, "cluster", "left").select("cluster", F.concat(F.lit("DOB: "), "birth", F.coalesce(F.concat(F.lit(", Contact: "), "contact"), F.lit(""))).alias("Matched_On"))
    cells = [F.col("service_name").alias("Service_Name"), F.col("legacy_id").alias("Parent_Legacy_ID"), F.col("name").alias("Parent_Name"), "Matched_On", F.col("crn").alias("Parent_CRN"), F.col("slot").alias("Parent_Slot"), F.col("child").alias("Linked_Child")]
    out = member.join(matched, "cluster").select(*cells, F.struct(F.lit(0).alias("part"), "cluster", "service_name", "child", "ord").alias("place"))
    if cross is not None:
        also = rows.join(cross.select("row_num", "slot", F.col("details").alias("Matched_On")), ["row_num", "slot"])
        out = out.unionByName(also.select(*cells, F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("cluster"), F.lit("").alias("service_name"), F.lit("").alias("child"), "ord").alias("place")))
    # The number is by one order over all rows of the report: a sort by ranges, then counts by partition.
    return in_sequence(out, ["Parent_Name", "Service_Name", "place"], "seq").drop("place")
