"""Connected components of pairs, by alternating stars.

Large-star links each larger neighbour of a node to the least of its closed
neighbourhood, small-star does so for the others; the rounds end when every edge
joins a node to its component's least node, after few of them for long chains too.
Edges may stay inside blocks (a child's bookings, a name and birth date). Blocks of few
edges are solved in one pass, each in memory, many in a task; only those of more than
LOCAL edges go through rounds. Each round is a written table, so that plans stay short, sizes are known and a lost
executor costs one round; nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.lineage import discard, hot_bound, join_groups, place, written

#: Edges to a partition: rounds take as many tasks as their edges need, not as many as the session's shuffles have.
PART = 100_000

#: Edges up to which a block is solved in memory.
LOCAL = 100_000


def least_reachable(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node of the edges, and the least node reachable from it."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for x, y in zip(a, b):
        p, q = root(x), root(y)
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(up)}


def _solved(edges: DataFrame, block: list[str]) -> DataFrame:
    """(block, node, root) of blocks that fit in memory: they are dealt whole, and a task holds one at a time."""
    schema = edges.select(*block, F.col("a").alias("node"), F.col("b").alias("root")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, [], []
        done: list[list] = [[] for _ in arrow]  # one list a column, so that many small blocks make one batch

        def flush() -> None:
            found = least_reachable(a, b)
            for k, column in zip(now, done):
                column += [k] * len(found)
            done[-2].extend(found)
            done[-1].extend(found.values())

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, arrow)], schema=arrow)
            for c in done:
                c.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_pylist() for c in block]
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in block]
            change = np.zeros(batch.num_rows, bool)
            for code in codes:
                change[1:] |= code[1:] != code[:-1]
            edges_ = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for low, high in zip(edges_[:-1], edges_[1:]):
                key = tuple(k[low] for k in keys)
                if key != now:
                    if now is not None:
                        flush()
                    now, a, b = key, [], []
                a += left[low:high]
                b += right[low:high]
            if done[-1]:
                yield batch_of()
        if now is not None:
            flush()
            yield batch_of()

    dealt = edges.repartition(*block).sortWithinPartitions(*block)
    return dealt.mapInArrow(run, schema)


def _dealt(edges: DataFrame, key: list[str], n_edges: int) -> DataFrame:
    return edges.repartition(max(8, n_edges // PART), *key)


def _star(edges: DataFrame, block: list[str], large: bool, n_edges: int) -> DataFrame:
    """edges: (block, a, b) with a > b. Counts, joins and distinct rows all go by the one dealing of edges to their nodes."""
    key = [*block, "a"]
    pairs = edges.unionByName(edges.select(*block, F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    pairs = _dealt(pairs, key, n_edges)
    least = pairs.groupBy(*key).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    joined = join_groups(pairs, least, key, "n", hot_bound(n_edges))
    if large:
        out = joined.where("b > a").select(*block, F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(*block, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(*block, "a", F.col("m").alias("b")))
    return _dealt(out, key, n_edges).distinct()


def component_labels(edges: DataFrame, block: list[str] | None = None) -> DataFrame:
    """(block, node, root) for every node of `edges` (block, a, b) with an edge to another: root is the component's least node.

    The rounds go on until one leaves the edges as they are; no number of rounds is given.
    """
    if not block:
        return _by_rounds(edges.where("a <> b"), [])
    edges = written(edges.where("a <> b").select(*block, "a", "b"), "edges")
    # Of larger blocks there are at most as many as the edges over LOCAL.
    large = written(edges.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL).select(*(F.col(k).alias(f"_{k}") for k in block)), "large")
    if large.isEmpty():
        return _solved(edges, block)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in block]
    split = lambda how: edges.join(F.broadcast(large), same, how)
    return _solved(split("left_anti"), block).unionByName(_by_rounds(split("left_semi"), block))


def _by_rounds(edges: DataFrame, block: list[str]) -> DataFrame:
    spark, start = edges.sparkSession, place()
    now = written(edges.select(*block, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*block, "a", "b").cast("decimal(38,0)")), F.lit(0)))
    before = now.agg(mark.alias("mark")).first().mark
    while before.n:
        half = _star(now, block, True, before.n)
        # Where hot nodes are joined apart, a round's first half is read twice.
        now = written(_star(half if hot_bound(before.n) is None else written(half, "half"), block, False, before.n), "edges")
        discard(spark, start)
        after = now.agg(mark.alias("mark")).first().mark
        if after == before:
            break
        before = after
    return now.select(*block, F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(*block, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def block_components(nodes: DataFrame, edges: DataFrame, block: list[str], node: str) -> DataFrame:
    """nodes (block, node) with component, the least node reachable over edges (block, a, b).

    A node without an edge is a component of its own.
    """
    roots = component_labels(edges, block).select(*block, F.col("node").alias(node), F.col("root").alias("component"))
    return nodes.select(*block, node).join(roots, [*block, node], "left").withColumn("component", F.coalesce("component", node))
