"""Helpers shared by the operators of this subpackage.

Rule for clashing names: where extra input columns pass through, an input column
that has the name of a result column is replaced, and columns that an operator
makes for itself take names that the input has not. Operators that return other
rows than they get (formatted conversations, archive records, groups of copies)
say which columns those have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the size and shingle contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of `names` that no column of `df` has, in any case, for columns that are dropped again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, needs: list[str], adds: T.StructType, function: Callable[[list[list]], list[list]]) -> DataFrame:
    """Add columns that a function of Python lists computes batch by batch.

    `function` gets the lists of the columns `needs` (texts as UTF-8 bytes, null
    as None) and returns a list for each field of `adds`.
    """
    # Spark tells no names apart that differ in case only.
    names = {f.name.lower() for f in adds}
    kept = [f for f in df.schema if f.name.lower() not in names]
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    arrow = to_arrow_schema(adds)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(b.column(n).cast(pa.binary()) if n in texts else b.column(n)).to_pylist() for n in needs]
            made = function(got) if b.num_rows else [[] for _ in arrow]
            columns = [b.column(n) for n in keep] + [pa.array(x, f.type) for x, f in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=keep + arrow.names)

    return df.mapInArrow(run, T.StructType(kept + list(adds)))
