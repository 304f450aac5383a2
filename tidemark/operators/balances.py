"""Account balances: amounts, names, known centres and duplicate accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.lineage import join_found


def centre_column(columns: list[str]) -> str | None:
    """The column of centre names, spelt either way, in any case and spacing."""
    return next((c for c in columns if c.lower().replace(" ", "").replace("_", "") in ("centername", "centrename")), None)


def balance_columns(df: DataFrame) -> DataFrame:
    """The columns of a balance file under the names that resolve_balances has: account_name, credit, owing, amount_due."""
    known = {"accountname": "account_name", "credit": "credit", "owing": "owing", "amountdue": "amount_due"}
    return df.withColumnsRenamed({c: new for c in df.columns if (new := known.get(c.lower().replace(" ", "").replace("_", "")))})


def resolve_balances(df: DataFrame, known: DataFrame) -> DataFrame:
    """(src_row, centre, first, last, credit, owing) of accounts at known centres, without demo accounts.

    Credit and owing columns win; else a signed amount due is split by its sign.
    """
    centre = centre_column(df.columns)
    if centre is None:
        return df.sparkSession.createDataFrame([], "src_row long, centre string, first string, last string, credit double, owing double")
    rows = df.where(~F.coalesce(F.lower("account_name").contains("demo parent"), F.lit(False))).withColumn("centre", text.strip(centre))
    rows = rows.join(known.select(F.trim("service_name").alias("centre")).where("centre <> ''").distinct(), "centre", "left_semi")
    if {"credit", "owing"} <= set(df.columns):
        credit, owing = text.amount("credit"), text.amount("owing")
    else:
        due = text.amount("amount_due")
        credit, owing = F.when(due < 0, -due), F.when(due > 0, due)
    return rows.select("src_row", "centre", text.first_name("account_name").alias("first"), text.last_name("account_name").alias("last"), credit.alias("credit"), owing.alias("owing"))


def skipped_centres(df: DataFrame, known: DataFrame) -> DataFrame:
    centre = text.strip(centre_column(df.columns))
    return df.select(centre.alias("centre")).where("centre <> ''").join(known.select(F.trim("service_name").alias("centre")), "centre", "left_anti").distinct()


def duplicate_accounts(balances: DataFrame) -> DataFrame:
    """All accounts that share centre and names, in any case, with their number."""
    key = F.struct(F.lower("centre").alias("c"), F.lower("first").alias("f"), F.lower("last").alias("l"))
    keyed = balances.withColumn("_key", key)
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_found(keyed, groups, ["_key"], "n").drop("_key")
