"""Row numbers without a window over a whole group.

Rows are counted by group and span of the order, the counts are summed along the
spans, and windows only run inside one span of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import written

SPAN = 65_536


def numbered(df: DataFrame, keys: list[str], order: str, name: str, first: int = 1, span: int = SPAN) -> DataFrame:
    """Add `name`: the row's number in its group, from `first`, by a column of whole numbers that tells the rows of a group apart.

    The keys are never null. Without keys all rows are one group.
    """
    placed = df.withColumn("_span", F.floor(F.col(order) / span))
    counts = placed.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    along = (Window.partitionBy(*keys) if keys else Window).orderBy("_span")
    counts = counts.select(*keys, "_span", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order))
    out = placed.withColumn("_within", within).join(counts, [*keys, "_span"])
    return out.withColumn(name, F.col("_before") + F.col("_within") + (first - 1)).select(*df.columns, name)


def in_sequence(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add `name`: the row's number from 1 in the order of columns of any type, null first.

    Rows are sorted by ranges and written; a row's number is the count of the ranges before
    its own, plus its place in it. Only one count a range is summed along. The rows are
    written before, as ranges are found by reading them once more.
    """
    ranged = written(df, "unsorted").repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    counts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
