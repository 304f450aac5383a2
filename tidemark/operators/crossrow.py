"""Checks over several rows: duplicates and contradictions by key.

Each groups by its key with partial aggregation and joins the flagged keys, few
as a rule, back to the rows, by a broadcast where they are few. Blank keys leave before the shuffle, so that the most
frequent "value" never makes a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.lineage import join_found


def _flag(df: DataFrame, key: Column, wrong: Column, *extra: Column, keep: list[str]) -> DataFrame:
    """(keep, key, n, extra) of the rows whose key's group is wrong. Aggregates see the columns of `df`."""
    keyed = df.withColumn("_key", key).where("_key <> ''")
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), wrong.alias("_wrong"), *extra).where("_wrong").drop("_wrong")
    return join_found(keyed.select(*keep, "_key"), groups, ["_key"], "n").withColumnRenamed("_key", "key")


def duplicate_members(df: DataFrame, field: str, row_col: str = "row_num") -> DataFrame:
    """Every row whose value, in any case, occurs more than once: (row, key, n, first_row). Rows of one key name it, so nothing grows with the square of a group."""
    return _flag(df, text.norm(field), F.count(F.lit(1)) > 1, F.min(row_col).alias("first_row"), keep=[row_col])


def duplicate_values(df: DataFrame, field: str, row_col: str = "row_num") -> DataFrame:
    """Every row whose value, in any case, occurs more than once, with the sorted rows that have it.

    That is the report's form, with a list a row; `duplicate_members` gives the same rows without lists.
    """
    rows = F.array_sort(F.collect_list(row_col)).alias("related_rows")
    return _flag(df, text.norm(field), F.count(F.lit(1)) > 1, rows, keep=[row_col]).withColumn("field", F.lit(field))


def email_conflicts(df: DataFrame, prefix: str, severity_by_identity: bool, row_col: str = "row_num") -> DataFrame:
    """Rows whose parent e-mail belongs to several identities (or, without that test, occurs at all more than once)."""
    wrong = F.count_distinct(text.identity_key(prefix, df.columns)) > 1 if severity_by_identity else F.count(F.lit(1)) > 1
    out = _flag(df, text.norm(f"{prefix}_Email"), wrong & (F.count(F.lit(1)) > 1), keep=[row_col])
    return out.withColumns({"field": F.lit(f"{prefix}_Email"), "severity": F.lit("ERROR" if severity_by_identity else "WARNING")})


def crn_registry(df: DataFrame, prefix: str, row_col: str = "row_num") -> DataFrame:
    """Rows whose parent CRN goes with several e-mail addresses, with these in order."""
    email = text.or_null(text.norm(f"{prefix}_Email"))
    emails = F.array_join(F.array_sort(F.collect_set(email)), ", ").alias("emails")
    return _flag(df, text.norm(f"{prefix}_CRN"), F.count_distinct(email) > 1, emails, keep=[row_col]).withColumn("field", F.lit(f"{prefix}_CRN / {prefix}_Email"))


def enrolment_crn_unknown(df: DataFrame, row_col: str = "row_num") -> DataFrame:
    """Rows whose enrolment CRN is neither parent's (case counts)."""
    value = text.strip("Enrolment_Parent_CRN")
    parents = [text.strip(c) for c in ("Parent1_CRN", "Parent2_CRN") if c in df.columns]
    return df.where((value != "") & ~value.isin(*parents)).select(row_col, value.alias("value"))
