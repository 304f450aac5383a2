"""Sinks: a folder for each split, and the issue log.

A split (a service, a kind and service, a centre) is one sequence of lines: its
header, then its rows in order. Rows are numbered in their split first, and `SPAN`
of them are one file, in a folder of the split's `part`; the header stands in the first
file alone. So a split of up to SPAN rows is one file, a larger one several that
many tasks write, and these files one after the other are the split: line n + 1 is row n.
The numbers make a file's rows, not the order in which tasks end, and Spark's
committer keeps one attempt of each task, so a repeated attempt leaves the same lines.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.lineage import HOT, join_groups, written
from tidemark.plans.numbering import in_sequence
from tidemark.plans.repairs import split_rows
from tidemark.sources.split_csv import csv_records


def family_splits(df: DataFrame, service_map: DataFrame | None = None) -> DataFrame:
    """Add service, split_row and service_label: the service name of the service's first row, else the map's, else the id."""
    rows = split_rows(df)
    label = rows.groupBy("service").agg(F.min_by(text.strip("Service_Name") if "Service_Name" in df.columns else F.lit(""), "row_num").alias("label"))
    shown = [text.or_null(F.col("label"))]
    if service_map is not None:
        label = label.join(names_by_target(service_map), "service", "left")
        shown.append(text.or_null(F.col("mapped")))
    label = label.select("service", F.coalesce(text.or_null(text.file_label(F.coalesce(*shown, "service"))), F.lit("Unknown")).alias("service_label"))
    return rows.join(label, "service")


def names_by_target(service_map: DataFrame) -> DataFrame:
    """(service, mapped): the name of each target id; of several rows the last counts."""
    known = service_map.where(~text.is_blank("target_service_id"))
    return known.groupBy(text.strip("target_service_id").alias("service")).agg(F.max_by(text.strip("service_name"), "map_ord").alias("mapped"))


def write_family_splits(df: DataFrame, columns: list[str], path: str, fmt: str = "csv", service_map: DataFrame | None = None) -> None:
    """A folder a service label; rows in order, with their number in the service's split as split_row."""
    rows = family_splits(df, service_map)
    # Services that share a label share its lines, one service after the other.
    write_splits(_in_split(rows, ["service_label"], "service", "split_row"), ["service_label"], "_place", ["split_row", *columns], path, fmt)


def booking_splits(template: DataFrame, service_map: DataFrame | None = None) -> DataFrame:
    """Add booking_kind (Casual or Recurring) and service_label: the service's name as a file name, else its id, UNMAPPED for none."""
    kind = F.when(F.upper("week_type") == "CASUAL", "Casual").otherwise("Recurring")
    if service_map is not None:
        named = names_by_target(service_map).withColumnsRenamed({"service": "_service", "mapped": "_mapped"})
        template = template.join(named, F.col("service_id") == F.col("_service"), "left")
        label = text.file_word(F.coalesce(text.or_null(F.col("_mapped")), "service_id"))
    else:
        label = text.file_word("service_id")
    return template.withColumns({"booking_kind": kind, "service_label": F.coalesce(text.or_null(label), F.lit("UNMAPPED"))}).drop("_service", "_mapped")


def write_booking_splits(template: DataFrame, path: str, fmt: str = "csv", service_map: DataFrame | None = None) -> None:
    """Folders of kind and service; rows in order of child."""
    keys = ["booking_kind", "service_label"]
    write_splits(_in_split(booking_splits(template, service_map), keys, "child_id", "src_row"), keys, "_place", template.columns, path, fmt)


def write_payment_splits(template: DataFrame, path: str, fmt: str = "csv") -> None:
    """A folder a service name, in the columns of the import file; rows in order."""
    labelled = template.withColumn("service_label", text.file_label("Service_Name"))
    write_splits(_in_split(labelled, ["service_label"], "Service_ID", "file_row"), ["service_label"], "_place", template.columns, path, fmt)


def write_repaired_payments(repaired: DataFrame, columns: list[str], path: str) -> None:
    """All repaired payment plans in the columns of the input."""
    repaired.select(*columns).write.mode("overwrite").options(**OPTIONS).csv(path)


def write_balances(resolved: DataFrame, path: str, fmt: str = "csv") -> None:
    """By centre, and all centres together; rows in order."""
    resolved = written(resolved, "resolved")
    labelled = resolved.withColumn("centre_label", text.file_part("centre"))
    write_splits(_in_split(labelled, ["centre_label"], "src_row"), ["centre_label"], "_place", resolved.columns, f"{path}/by_centre", fmt)
    write_splits(_in_split(resolved, [], "src_row"), [], "_place", resolved.columns, f"{path}/all", fmt)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").options(**OPTIONS).csv(path)


#: White space at the ends of cells is written as it is; quotes in cells are doubled.
OPTIONS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
#: Rows of one file.
SPAN = 1_000_000


def _in_split(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Add _place, a row's number from 1 on in its split by an order of columns, whatever a split's size. Null keys become "Unknown"."""
    labelled = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("Unknown")) for k in keys})
    placed = in_sequence(labelled, [*keys, *order], "_place")
    if not keys:
        return placed
    first = placed.groupBy(*keys).agg((F.min("_place") - 1).alias("_before"), F.count(F.lit(1)).alias("_rows"))
    return join_groups(placed, first, keys, "_rows", HOT).withColumn("_place", F.col("_place") - F.col("_before")).drop("_before", "_rows")


def write_splits(df: DataFrame, keys: list[str], place: str, columns: list[str], path: str, fmt: str = "csv", span: int = SPAN) -> None:
    """Folders of `keys` and part: part k holds the rows with the numbers k * span + 1 to (k + 1) * span in their split, in order.

    `place` numbers the rows of a split from 1 on without gaps. CSV files have the header as the line
    before row 1, and all cells as texts. A table without rows gives no files.
    """
    # Never null: the writer would sort anew by keys that may be, and forget the order below.
    label = [F.coalesce(F.col(k).cast("string"), F.lit("Unknown")).alias(k) for k in keys]
    if fmt == "csv":
        rows = df.select(*label, F.col(place).alias("__n"), *(F.col(c).cast("string").alias(f"_c_{c}") for c in columns))
        lead = rows.select(*keys).distinct() if keys else rows.limit(1).select(F.lit(1))
        rows = rows.unionByName(lead.select(*keys, F.lit(0).cast("long").alias("__n"), *(F.lit(c).alias(f"_c_{c}") for c in columns)))
        options = OPTIONS | {"header": False}
    else:
        rows, options = df.select(*label, F.col(place).alias("__n"), *(F.col(c).alias(f"_c_{c}") for c in columns)), {}
    rows = rows.withColumn("part", F.greatest(F.floor((F.col("__n") - 1) / span), F.lit(0)))
    # All rows of a file meet in one task.
    placed = rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "__n").drop("__n")
    placed = placed.withColumnsRenamed({f"_c_{c}": c for c in columns}) if fmt != "csv" else placed
    placed.write.mode("overwrite").options(**options).partitionBy(*keys, "part").format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """What write_splits has written as CSV: the keys, line (a record's place in its split, 0 the header's) and its text.

    Lines are counted in the files as they lie there.
    """
    found = csv_records(spark, [r.path for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator()])
    places = []
    for i, f in enumerate(found.files):
        words = dict(w.split("=", 1) for w in f.split("/") if "=" in w)
        part = int(words.pop("part"))
        places.append((i, part * span + (part > 0), {k: unquote(v) for k, v in words.items()}))
    known = spark.createDataFrame(places, "file int, _first long, keys map<string,string>")
    return found.rows.join(F.broadcast(known), "file").select("keys", (F.col("record") + F.col("_first")).alias("line"), "text")
