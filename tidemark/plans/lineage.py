"""Cutting lineage with tables in the folder that driver and executors share.

A written table outlives lost executors, and Catalyst knows its size on disk, so
that plans over it stay short and joins with it are broadcast only where it is
small. Tables of earlier steps can be discarded once a later one stands; what an
application leaves behind is removed by `sweep`.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
#: Rows from which on a group is hot: of such groups there are at most a millionth of the rows.
HOT = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session or the context has it.

    Only a master of one machine may do without that setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing else has; `discard` and `sweep` remove it."""
    _made.append(f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """`df` as a written table, and aggregates of its rows that the writing job observes on the way, without a read of its own.

    Rows are observed in the last stage, where a repeated task counts once. An aggregate's
    state goes to the driver from each task, so it must be bounded.
    """
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    table = written(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), label)
    return table, dict(seen.get)


def place() -> int:
    """The place to which a later `discard` goes back."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the folders made since a place, but for the last `keep` of them."""
    upto = len(_made) - keep
    for path in _made[since:upto]:
        _remove(spark, path)
    del _made[since : max(since, upto)]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Remove what earlier runs left in the shared folder and nothing has changed for `hours`; how many folders."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark")
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(top):
        return 0
    before = (time.time() - 3600 * hours) * 1000
    old = [f.getPath() for f in store.listStatus(top) if f.getModificationTime() < before]
    return sum(bool(store.delete(path, True)) for path in old)


def fits(df: DataFrame, rows: int, megabytes: int = 64) -> bool:
    """Whether a written table has few rows and few bytes on disk."""
    bound = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= megabytes << 20
    return bound and df.count() <= rows


def small(df: DataFrame, rows: int, megabytes: int = 64) -> DataFrame:
    """Mark a written table for broadcast if it has few rows and few bytes on disk; else leave the join to Catalyst."""
    return F.broadcast(df) if fits(df, rows, megabytes) else df


def hot_bound(rows: int) -> int | None:
    """From how many rows on a group of a table of so many is hot: over a thousandth of them; none is in a table of under a million."""
    return rows // 1000 if rows >= HOT else None


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], n: str, over: int | None) -> DataFrame:
    """Join rows to their group's row; groups of more than `over` rows are broadcast, so no task holds a hot group.

    `groups` has one row a key and its number of rows in `n`. With `over` a fixed share
    of all rows there are only a fixed number of such groups. `rows` is read twice.
    Without `over` it is a plain join.
    """
    if over is None:
        return rows.join(groups, key)
    hot = F.broadcast(groups.where(F.col(n) > over))
    others = rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col(n) <= over), key)
    return rows.join(hot, key).unionByName(others)


def join_found(rows: DataFrame, groups: DataFrame, key: list[str], n: str, broadcast_rows: int = 250_000) -> DataFrame:
    """Join rows to the groups that a check has found, few as a rule: these are written, and broadcast if they are few.

    Only where they are many are rows shuffled, and read twice only where a group is hot.
    """
    groups = written(groups, "found")
    if fits(groups, broadcast_rows):
        return rows.join(F.broadcast(groups), key)
    return join_groups(rows, groups, key, n, None if groups.where(F.col(n) > HOT).isEmpty() else HOT)
