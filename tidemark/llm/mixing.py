"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule takes the point frac(n * golden ratio), kept as an
integer of 32 bits, and the source in whose interval of cumulated targets the
point lies. The r-th slot of a source takes the r-th block of `block` words of
that source's shuffled word stream, which runs over its documents `epochs`
times. Neighbouring slots thus hold all sources near their weights, and each
source ends within a few blocks of its target.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, the last; a source without words has target 0;
repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.plans.lineage import small, written

GOLDEN = 2654435769  # 2**32 / golden ratio, rounded to odd
BINS = 4096
RESULT = ("size", "source_size", "target", "taken")


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(n: Column) -> Column:
    """n * GOLDEN modulo 2**32, in steps that stay within a long for any n."""
    low, high = n % 65536, F.floor(n / 65536).cast("long") % 65536
    return (((high * GOLDEN) % 65536) * 65536 + low * GOLDEN) % (1 << 32)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, idx, source_size, target) for (source, size) rows.

    Targets share `budget` times all sizes by weight. A target that would pass
    `epochs` times its source's size stops there, and the rest is shared by the
    other weights. Taken in ascending order of size over weight, sources are capped
    as long as the level of what is left would cap them, which is the fixed point
    of that resharing. All windows here run over one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("idx", F.row_number().over(every) - 1)
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("long"))
    rising = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    total = total.withColumns({
        "left": F.lit(budget) * F.sum("source_size").over(whole) - F.lit(epochs) * F.coalesce(F.sum("source_size").over(rising), F.lit(0)),
        "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0)),
    })
    # The first source, in that order, that its level does not cap sets the level of all after it.
    level = F.min_by(F.struct("left", "rest"), F.when(F.col("weight") * F.col("left") <= epochs * F.col("source_size") * F.col("rest"), F.struct(F.col("source_size") / F.col("weight"), "idx"))).over(whole)
    total = total.withColumn("level", level)
    share = F.col("weight") * F.col("level.left") / F.col("level.rest")
    cap = (F.lit(epochs) * F.col("source_size")).cast("double")
    return total.select("source", "idx", "source_size", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, share)).alias("target"))


def schedule(targets: DataFrame, block: int = 64, chunk: int = 1 << 16) -> DataFrame:
    """The slots: (slot, idx, rank), rank from 0 in each source.

    Points meet the sources' intervals by bin, so no task sees all sources for a
    slot. Ranks come from counts by (chunk of slots, source), summed over chunks,
    and a row number inside each chunk: no window holds all slots of a hot source.
    """
    spark = targets.sparkSession
    n_slots = int(targets.agg(F.coalesce(F.ceil(F.sum("target") / block), F.lit(0))).first()[0])
    run = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ends = targets.select("idx", F.sum("target").over(run).alias("upto"), F.sum("target").over(Window.partitionBy(F.lit(1))).alias("all"))
    ends = ends.select("idx", F.floor(F.try_divide("upto", "all") * (1 << 32)).cast("long").alias("high"))
    bounds = ends.select("idx", F.coalesce(F.lag("high").over(Window.orderBy("idx")), F.lit(0)).alias("low"), "high").where("low < high")
    width = (1 << 32) // BINS
    bounds = bounds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") / width))
    slots = points.join(small(written(bounds, "bounds"), 1_000_000), "bin").where("point >= low and point < high")
    slots = slots.select("slot", "idx", F.floor(F.col("slot") / chunk).alias("chunk"))
    before = slots.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("idx", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot"))
    return slots.withColumn("inside", inside).join(before, ["idx", "chunk"]).select("slot", "idx", (F.col("before") + F.col("inside") - 1).alias("rank"))


def streams(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Add each document's place in its source's shuffled stream: idx, source_size, target, at.

    The shuffle order is a seeded hash. Its first three digits give 4096 buckets a
    source, whose sizes are summed first, so that offsets need windows over single buckets only.
    """
    order = docs.join(small(targets, 1_000_000), F.col("source").eqNullSafe(F.col("_source")))
    order = order.withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "_id", "_text").cast("binary")))
    order = order.withColumn("bucket", F.substring("order", 1, 3)).drop("_text")
    sums = order.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("idx", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("idx", "bucket").orderBy("order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return order.withColumn("inside", inside).join(sums, ["idx", "bucket"]).withColumn("at", F.col("before") + F.col("inside")).drop("order", "bucket", "before", "inside")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], budget: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents (_row, _id, size, source_size, target, idx, at), and the targets."""
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), *RESULT}]
    plain = docs.select(F.struct(*others).alias("_row") if others else F.lit(None).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), F.md5(F.col(text_col).cast("binary")).alias("_text"))
    plain = written(plain, "sizes")
    targets = written(source_targets(plain.select("source", "size"), weights, budget, epochs), "targets")
    return written(streams(plain, targets.withColumnRenamed("source", "_source"), seed), "placed"), targets


def _pieces(placed: DataFrame, targets: DataFrame, epochs: int, block: int, *keep: str) -> DataFrame:
    """(keep, idx, at, slot, epoch, start, words): the join of scheduled slots with the blocks of the streams."""
    pieces = placed.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    pieces = pieces.select(*keep, "idx", "at", "epoch", (F.col("at") + F.col("epoch") * F.col("source_size")).alias("a"), "size")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))))
    start = F.greatest(F.col("a"), F.col("rank") * block)
    words = F.least(F.col("a") + F.col("size"), (F.col("rank") + 1) * block) - start
    pieces = pieces.select(*keep, "idx", "at", "epoch", "rank", (start - F.col("a")).alias("start"), words.alias("words"))
    return pieces.join(schedule(targets, block), ["idx", "rank"]).drop("rank")


def mix_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, epochs: int = 2, block: int = 64, seed: int = 20) -> DataFrame:
    """The mix itself: (slot, place, id, source, epoch, start, words), a row for each piece of a document in a slot.

    Read by slot and place, the pieces are the mixed stream: `words` words of the
    document from word `start` on. A slot holds one block of one source.
    """
    placed, targets = _placed(docs, id_col, text_col, source_col, weights, budget, epochs, seed)
    pieces = _pieces(placed, targets, epochs, block, "_id", "source")
    return pieces.select("slot", F.col("at").alias("place"), F.col("_id").alias("id"), "source", "epoch", "start", "words")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, epochs: int = 2, block: int = 64, seed: int = 20) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes, repeats counted): the pieces' words summed by document.

    Everything but `text_col` passes through; the text itself is not shuffled.
    """
    placed, targets = _placed(docs, id_col, text_col, source_col, weights, budget, epochs, seed)
    taken = _pieces(placed, targets, epochs, block).groupBy("idx", "at").agg(F.sum("words").alias("taken"))
    full = F.when(F.col("size") > 0, F.col("at"))  # only documents with words have a place of their own
    out = placed.withColumn("_at", full).join(taken.withColumnsRenamed({"idx": "_idx", "at": "_at2"}), (F.col("idx") == F.col("_idx")) & (F.col("_at") == F.col("_at2")), "left")
    return out.select("_row.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
