"""Payment plans: repairs, twelve kinds of error, and the split by service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.plans.numbering import numbered

#: The error kinds in order of priority, and the accepted cycles.
KINDS = ("weekend", "missing_date", "missing_weekday", "missing_parent", "missing_service_id", "invalid_cycle", "manual_not_monday", "negative_limit", "negative_fixed", "both_amounts", "unparseable_date", "unknown_weekday")
CYCLES = ("weekly", "fortnightly", "monthly")
#: For each kind its label, its key in the importing system, the form of its note and the cells that fill it.
DETAIL = {
    "weekend": ("WEEKEND — Sat / Sun", "ERROR_INVALID_PAYMENT_DAY", "Falls on a %s (%s) — please verify before importing", ("long_day", "start_date")),
    "missing_date": ("Missing Start Date", "ERROR_MISSING_BOOKING_START_DATE", "Start Date is empty — cannot import", ()),
    "missing_weekday": ("Missing Weekday", "ERROR_MISSING_PAYMENT_DAY", "Weekday is empty — cannot import", ()),
    "missing_parent": ("Missing Parent Name", "ERROR_MISSING_GUARDIAN", 'First: "%s"  Last: "%s"', ("given_fn", "given_ln")),
    "missing_service_id": ("Missing Service ID", "ERROR_MISSING_SERVICE_ID", "Service ID is empty (required field)", ()),
    "invalid_cycle": ("Invalid Billing Cycle", "ERROR_INVALID_FREQUENCY", 'Value: "%s" — must be Weekly / Fortnightly / Monthly', ("cycle",)),
    "manual_not_monday": ("Manual Plan — Not Monday", "MANUAL_PLAN_NOT_MONDAY", "Starts on %s (%s) — Manual plans must start on Monday", ("start_day", "start_date")),
    "negative_limit": ("Negative Direct Debit Limit", "ERROR_NEGATIVE_DIRECT_DEBIT_LIMIT", "Value = %s  (must be >= 0)", ("dd_limit",)),
    "negative_fixed": ("Negative Fixed Amount", "ERROR_NEGATIVE_FIXED_LIMIT", "Value = %s  (must be >= 0)", ("fixed_amount",)),
    "both_amounts": ("Both Limit + Fixed Amount Set", "ERROR_ONLY_ONE_AMOUNT_ALLOWED", "Limit=%s  AND  Fixed=%s  (only one allowed)", ("dd_limit", "fixed_amount")),
    "unparseable_date": ("Unparseable Date Value", "UNPARSEABLE_DATE", 'Cannot parse: "%s"', ("raw_date",)),
    "unknown_weekday": ("Unknown Weekday Value", "UNKNOWN_WEEKDAY", 'Unrecognised value: "%s"', ("raw_weekday",)),
}
#: Columns of the import file after the service's two, and what fills them.
TEMPLATE = {
    "Parent_Legacy_Id": "parent_id",
    "Parent_First_Name": "parent_fn",
    "Parent_Last_Name": "parent_ln",
    "Child_Legacy_Id": "child_id",
    "Child_First_Name": "child_fn",
    "Child_Last_Name": "child_ln",
    "Direct_Debit_Start_Date": "start_date",
    "Direct_Debit_Day": "weekday",
    "Manual": "manual",
    "Billing_Cycle": "cycle",
    "Direct_Debit_Limit": "dd_limit",
    "Fixed_Amount": "fixed_amount",
    "Gateway_Reference": "gateway",
}


def map_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Logical names for the columns of a file: {logical: actual}."""
    return df.select("row_num", *(text.col(actual).alias(logical) for logical, actual in names.items()))


def repair_plans(df: DataFrame) -> DataFrame:
    """Trim all cells, write dates as dd/MM/yyyy and weekdays with three letters; add what was changed and the date."""
    cells = [c for c in df.columns if c != "row_num"]
    spaces = sum((F.when(text.strip(c) != text.text(c), 1).otherwise(0) for c in cells), F.lit(0))
    out = df.withColumn("spaces_fixed", spaces).withColumns({c: text.strip(c) for c in cells})
    day, name = dates.payment_date("start_date"), text.weekday_name("weekday")
    out = out.withColumns({"plan_date": day, "raw_date": F.col("start_date"), "raw_weekday": F.col("weekday"), "day_name": name})
    return out.withColumns({
        "date_fixed": F.coalesce(dates.shown(F.col("plan_date")) != F.col("raw_date"), F.lit(False)), "weekday_fixed": F.coalesce(F.col("day_name") != F.col("raw_weekday"), F.lit(False)),
        "start_date": F.coalesce(dates.shown(F.col("plan_date")), F.col("start_date")), "weekday": F.coalesce("day_name", "weekday"),
    })


def _wrong() -> dict[str, tuple]:
    """For each kind the condition on repaired rows, and the cell that it shows."""
    limit, fixed = text.number("dd_limit"), text.number("fixed_amount")
    either = lambda c, n: F.when(F.col(c) == "", F.lit(0.0)).otherwise(n)
    return {
        "weekend": (F.col("day_name").isin("Sat", "Sun"), "day_name"),
        "missing_date": (F.col("raw_date") == "", "weekday"),
        "missing_weekday": (F.col("raw_weekday") == "", "raw_date"),
        "missing_parent": ((F.col("parent_fn") == "") | (F.col("parent_ln") == ""), "parent_id"),
        "invalid_cycle": ((F.col("cycle") != "") & ~F.lower("cycle").isin(*CYCLES), "cycle"),
        "manual_not_monday": (F.lower("manual").isin("yes", "1", "true") & (F.weekday("plan_date") != 0), "start_date"),
        "negative_limit": (limit < 0, "dd_limit"),
        "negative_fixed": (fixed < 0, "fixed_amount"),
        "both_amounts": ((either("dd_limit", limit) > 0) & (either("fixed_amount", fixed) > 0), "dd_limit"),
        "unparseable_date": ((F.col("raw_date") != "") & F.col("plan_date").isNull(), "raw_date"),
        "unknown_weekday": ((F.col("raw_weekday") != "") & F.col("day_name").isNull(), "raw_weekday"),
    }


def plan_errors(repaired: DataFrame) -> DataFrame:
    """(row_num, child_id, kind, value), in one narrow pass."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.col(v).alias("value"))) for k, (w, v) in _wrong().items())))
    return repaired.select("row_num", "child_id", F.explode(found).alias("x")).select("row_num", "child_id", "x.*")


def error_detail(repaired: DataFrame, span: int = 65_536) -> DataFrame:
    """(seq, label, key, row_num, parent_id, child_id, parent_name, service_name, note): errors by kind, then row, numbered from 1.

    Numbers come from counts by kind and span of `span` row numbers, so that no
    window holds a whole kind. Blank names show as (empty).
    """
    shown = lambda c: F.when(F.col(c) == "", "(empty)").otherwise(F.col(c))
    cells = repaired.withColumns({
        "parent_name": text.strip(F.concat_ws(" ", "parent_fn", "parent_ln")), "given_fn": shown("parent_fn"), "given_ln": shown("parent_ln"),
        "long_day": F.when(F.col("day_name") == "Sun", "Sunday").otherwise("Saturday"), "start_day": F.date_format("plan_date", "EEEE"),
    })
    order = {k: i for i, k in enumerate(KINDS)}

    def one(kind, wrong):
        label, key, form, fill = DETAIL[kind]
        return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(order[kind]).alias("place"), F.lit(label).alias("label"), F.lit(key).alias("key"), F.format_string(form, *fill).alias("note")))

    found = F.array_compact(F.array(*(one(k, w) for k, (w, _) in _wrong().items())))
    plain = ["row_num", "parent_id", "child_id", "parent_name", "service_name"]
    errors = cells.select(*plain, F.explode(found).alias("x")).select(*plain, "x.*").withColumn("bin", F.floor(F.col("row_num") / span))
    bins = errors.groupBy("place", "bin").agg(F.count(F.lit(1)).alias("n"))
    kinds = bins.groupBy("place").agg(F.sum("n").alias("n"))
    # At most one row for each kind.
    kinds = kinds.select("place", (F.sum("n").over(Window.orderBy("place")) - F.col("n")).alias("kind_first"))
    bins = bins.select("place", "bin", (F.sum("n").over(Window.partitionBy("place").orderBy("bin")) - F.col("n")).alias("bin_first"))
    within = F.row_number().over(Window.partitionBy("place", "bin").orderBy("row_num", "child_id", "note"))
    placed = errors.join(bins.join(F.broadcast(kinds), "place"), ["place", "bin"])
    return placed.withColumn("seq", F.col("kind_first") + F.col("bin_first") + within).select("seq", "label", "key", *plain, "note")


def error_summary(errors: DataFrame) -> DataFrame:
    """(seq, kind, n) for every kind, also those without errors, and TOTAL."""
    spark = errors.sparkSession
    kinds = spark.createDataFrame([(i, k) for i, k in enumerate(KINDS, 1)], "seq long, kind string")
    counts = kinds.join(F.broadcast(errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))), "kind", "left").select("seq", "kind", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.unionByName(counts.agg(F.lit(len(KINDS) + 1).cast("long").alias("seq"), F.lit("TOTAL").alias("kind"), F.sum("n").alias("n")))


def plan_stats(repaired: DataFrame) -> DataFrame:
    return repaired.agg(F.count(F.lit(1)).alias("total"), F.count_if("date_fixed").alias("date_fixed"), F.count_if("weekday_fixed").alias("weekday_fixed"), F.coalesce(F.sum("spaces_fixed"), F.lit(0)).cast("long").alias("spaces_fixed"))


def split_plans(repaired: DataFrame, service_map: DataFrame, source_services: DataFrame) -> DataFrame:
    """Add target (by service id, else by service name) and file_row; rows that resolve neither way leave."""
    by_id = service_map.where(~text.is_blank("source_service_id")).groupBy(text.strip("source_service_id").alias("_id")).agg(F.max_by(text.strip("target_service_id"), "map_ord").alias("_target"))
    by_name = source_services.select(text.norm("name").alias("_name"), text.strip("service_id").alias("_id"), "dbid").where("_name <> ''").join(by_id, "_id").groupBy("_name").agg(F.max_by("_target", "dbid").alias("_named"))
    out = repaired.join(by_id, F.col("service_id") == F.col("_id"), "left").join(by_name, F.lower("service_name") == F.col("_name"), "left")
    out = out.withColumn("target", F.when(F.col("service_id") != "", F.col("_target")).otherwise(F.col("_named"))).where("target <> ''")
    return numbered(out, ["target"], "row_num", "file_row", first=2).withColumn("child_id", F.when(F.col("child_id") == "", "").otherwise(F.concat_ws("_", "target", "child_id"))).drop("_id", "_target", "_name", "_named")


def import_template(split: DataFrame, service_map: DataFrame) -> DataFrame:
    """Split rows in the columns of the import file, and file_row. Columns that the input lacks are blank."""
    named = service_map.where(~text.is_blank("target_service_id")).groupBy(text.strip("target_service_id").alias("target")).agg(F.max_by(text.strip("service_name"), "map_ord").alias("_named"))
    cells = {"Service_ID": "target", "Service_Name": "_named"} | TEMPLATE
    given = {*split.columns, "_named"}
    return split.join(named, "target").select("file_row", *((F.col(c) if c in given else F.lit("")).alias(out) for out, c in cells.items()))


def renumber(errors: DataFrame, split: DataFrame) -> DataFrame:
    """Errors with the row's number in its file; rows in no file keep their own."""
    return errors.join(split.select("row_num", "file_row", "target"), "row_num", "left").withColumn("file_row", F.coalesce("file_row", "row_num"))
