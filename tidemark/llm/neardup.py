"""Near-duplicate groups by bottom-k sketches, verified exactly.

A text's words are runs of non-white characters after lower-casing A-Z, its set
the distinct shingles of `width` words, as 64-bit hashes. Texts with one set are
one class; a class's 64-bit name is checked by 64 further bits. Steps:

1. A class's sketch is the `k` least hashes of its set; one hash function serves all.
2. Inverted lists: classes by retained value. Values of one class are dropped.
   Lists of up to `hot` classes give pairs, counted by shared values. With the
   values of longer lists, which a class counts as its hot values, a pair must reach
   `floor` times the smaller sketch, i.e. an estimate of about that similarity.
   Classes with so many hot values that these alone could reach that are linked to
   the least class of each of the rarest of their hot lists that two such classes
   must share, never pair by pair.
3. The components of these candidates are blobs. In a blob of up to `block` classes
   the union sketch of two classes, the k least hashes of both, tells the share of
   it that both have; from `floor` on the exact sets decide. Only a spanning forest
   of the links is emitted.
4. Larger blobs are refined level by level. They meet in blocks, each with the
   blob's `leaders`, the classes with the most hot values, so that each set travels
   once. Outsiders, which these links leave outside the blob's main group, meet all
   blocks. Where they are more than a block, first those classes of the blob leave
   that can have no link: over a quarter of their set is in no other class.
5. Components of the forests are the groups.

Two classes of similarity 0.75 or more share on average three quarters of their
union sketch. With k = 48 and floor = 0.4 the chance that they fall short of the
floor is below 1e-7 at 0.75 and less above; sets of up to k shingles are exact.
Beyond that nothing is capped. Work is linear in the documents, except for the
outsiders of step 4, which meet their blob in (outsiders / block) * (blob / block) groups.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing; repeated rows are copies; a null id stays null, and a class
of null ids only has the class's least id, null, as its component; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns
from tidemark.llm.shingles import shingle_sets
from tidemark.operators.components import component_labels
from tidemark.plans.lineage import hot_bound, join_groups, small, written


def set_id(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def with_sketches(docs: DataFrame, text_col: str, width: int, k: int) -> DataFrame:
    """Add node and check (the set's id, null if it is empty), n_shingles and sketch."""

    def function(got):
        sets = shingle_sets([t or b"" for t in got[0]], width)
        ids = [set_id(s) if len(s) else (None, None) for s in sets]
        return [[i[0] for i in ids], [i[1] for i in ids], [len(s) for s in sets], [s[:k].view(np.int64).tolist() for s in sets]]

    fields = [("node", T.LongType()), ("check", T.LongType()), ("n_shingles", T.LongType()), ("sketch", T.ArrayType(T.LongType()))]
    return add_columns(docs, [text_col], T.StructType([T.StructField(*f) for f in fields]), function)


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each class: node, copies, least (id), one (key and id of one row), n_shingles, sketch; low and high are its least and largest check."""
    some = rows.where("node is not null").groupBy("node")
    return written(some.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("key", "doc_id")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high")), "classes")


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and their classes; two sets that share a node but not the check are given nodes of their own."""
    classes = grouped(rows)
    clash = classes.where("low <> high").select("node", F.lit(True).alias("_clash"))
    if clash.isEmpty():
        return rows, classes
    marked = rows.join(F.broadcast(clash), "node", "left").withColumn("node", F.when(F.col("_clash"), F.xxhash64("node", "check")).otherwise(F.col("node")))
    rows = written(marked.drop("_clash"), "sketches")
    return rows, grouped(rows)


def candidate_links(classes: DataFrame, hot: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): class pairs that may be similar, from (node, n_shingles, sketch); and (node, heat): the hot values of those that have any."""
    entries = classes.select("node", F.col("n_shingles").alias("n"), F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n_list"), F.min("node").alias("least")).where("n_list > 1")
    shared = written(join_groups(entries, lists, ["value"], "n_list", hot_bound(classes.count() * 48)), "shared")
    need = F.ceil(F.lit(floor) * F.col("k"))
    # At most k entries a class.
    heat = shared.where(F.col("n_list") > hot).groupBy("node", "k").agg(F.array_sort(F.collect_list(F.struct("n_list", "value", "least"))).alias("hots"))
    heat = written(heat.withColumn("heat", F.size("hots")), "heat")
    cool = shared.where(F.col("n_list") <= hot).join(heat.select("node", "heat"), "node", "left").select("value", "node", "n", "k", F.coalesce("heat", F.lit(0)).alias("heat"))
    other = cool.toDF("value", *(f"{c}2" for c in cool.columns[1:]))
    pairs = cool.join(other, "value").where("node < node2 and 4 * n >= 3 * n2 and 4 * n2 >= 3 * n")
    counted = pairs.groupBy("node", "node2", "k", "k2", "heat", "heat2").agg(F.count(F.lit(1)).alias("both"))
    near = counted.where(F.col("both") + F.least("heat", "heat2") >= F.ceil(F.lit(floor) * F.least("k", "k2"))).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    # Two classes that share `need` hot values share one of their `heat - need + 1` rarest.
    rarest = F.slice("hots", 1, F.col("heat") - need.cast("int") + 1)
    ends = heat.where(F.col("heat") >= need).select("node", F.explode(F.array_distinct(F.transform(rarest, lambda x: x["least"]))).alias("least"))
    links = near.unionAll(ends.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    return links, heat.select("node", "heat")


def sized_blobs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n_shingles, blob, members, shingles) of the classes that have a link; the last two are the blob's."""
    blobs = written(component_labels(links).withColumnRenamed("root", "blob").join(classes.select("node", "n_shingles"), "node"), "blobs")
    sizes = blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    return join_groups(blobs, sizes, ["blob"], "members", hot_bound(blobs.count()))


def class_texts(plain: DataFrame, rows: DataFrame, members: DataFrame, broadcast_rows: int) -> DataFrame:
    """The members (node, one, ...) with the text of one row each, found by key and id, with a broadcast up to `broadcast_rows` members and a join beyond."""
    named = members.withColumns({"_key": F.col("one.key"), "_id": F.col("one.doc_id")}).drop("one")

    def pick(of: DataFrame, some: DataFrame) -> DataFrame:
        chosen = some.withColumnRenamed("node", "_node") if "node" in of.columns else some
        return of.join(small(chosen, broadcast_rows), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    # Where the one row of a class is repeated, all but one of its texts stay out of the later shuffles.
    again = written(pick(rows.select("key", "doc_id"), named.select("node", "_key", "_id")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "repeated")
    if again.isEmpty():
        return pick(plain, named).drop("key", "doc_id", "_key", "_id")
    once = pick(plain, written(named.join(again, "node", "left_anti"), "chosen"))
    return once.unionByName(pick(plain, written(named.join(again, "node"), "chosen")).dropDuplicates(["node"])).drop("key", "doc_id", "_key", "_id")


def lonely_shares(sets: DataFrame, percent: int) -> DataFrame:
    """(node, lonely) of the classes that can have a link: lonely is the share of the set that no other class has.

    A batch's values are counted before they leave the task, so that a family's common ones leave it once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("set")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            nodes = np.repeat(b.column("node").to_numpy(), np.diff(offsets))
            value, first, times = np.unique(values[offsets[0] : offsets[-1]], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times), pa.array(nodes[first])], names=["value", "times", "node"])

    counted = sets.mapInArrow(count, "value long, times long, node long").groupBy("value").agg(F.sum("times").alias("times"), F.min("node").alias("node"))
    alone = counted.where("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    lonely = F.coalesce(F.col("alone") / F.col("n"), F.lit(0.0))
    return sets.select("node", F.size("set").alias("n")).join(alone, "node", "left").select("node", lonely.alias("lonely")).where(100 * (1 - F.col("lonely")) >= percent - 1e-6)


def estimates(own: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """The similarity of a sketch to others, estimated from their union sketches. Rows of `others` are filled up with the largest value.

    The j-th least value that both sketches retain, at places p and q of them, is at
    place p + q - j of the union; it counts if that is within the union's k least.
    """
    k = others.shape[1]
    place = np.searchsorted(own, others)
    hit = (own[np.minimum(place, len(own) - 1)] == others) & (np.arange(k) < sizes[:, None])
    rank = place + np.arange(k) + 2 - np.cumsum(hit, axis=1)
    union = np.minimum(k, size + sizes - hit.sum(axis=1))
    return (hit & (rank <= k)).sum(axis=1) / union


def common_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes a sorted set has in common with each of others."""
    values = np.concatenate(others)
    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
    ends = np.cumsum([len(o) for o in others])
    total = np.concatenate(([0], np.cumsum(own[place] == values)))
    return np.diff(total[np.concatenate(([0], ends))])


def similar_forest(ids: list[int], sets: list[np.ndarray], percent: int, k: int, floor: float) -> list[tuple[int, int]]:
    """Spanning edges (node, root) of the links among classes; ids ascend.

    Each class in turn meets those later ones that no link has joined to it yet: the
    union sketch first, then, from `floor` on, the exact sets. A family of near copies
    is thus joined by its first members, and no pair inside it is compared again.
    """
    n, size = len(ids), np.array([len(s) for s in sets])
    sketch = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        sketch[i, : min(k, size[i])] = s[:k]
    label = np.arange(n)
    for x in range(n - 1):
        ys = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        ys = ys[(100 * size[ys] >= percent * size[x]) & (100 * size[x] >= percent * size[ys])]
        if len(ys):
            ys = ys[estimates(sketch[x, : min(k, size[x])], sketch[ys], size[x], size[ys]) >= floor]
        if len(ys):
            both = common_counts(sets[x], [sets[y] for y in ys])
            linked = label[ys[100 * both >= percent * (size[x] + size[ys] - both)]]
            if len(linked):
                joined = np.append(linked, label[x])
                label[np.isin(label, joined)] = joined.min()
    return [(ids[i], ids[r]) for i, r in enumerate(label.tolist()) if r != i]


def _forests(batches: Iterator[pa.RecordBatch], width: int, percent: int, k: int, floor: float) -> Iterator[pa.RecordBatch]:
    """Rows (blob, i, j, node, and text or set) sorted by group, streamed; one group is held at a time."""

    def flush(group):
        if len(group) < 2:
            return []
        ids, values = list(group), list(group.values())
        return similar_forest(ids, shingle_sets(values, width) if isinstance(values[0], bytes) else values, percent, k, floor)

    def batch(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    def contents(b):
        if "text" in b.schema.names:
            return b.column("text").cast(pa.binary()).to_pylist()
        sets = b.column("set")
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        return [values[x:y].copy() for x, y in zip(offsets[:-1], offsets[1:])]

    now, group = None, {}
    for b in batches:
        edges = []
        keys = list(zip(*(b.column(c).to_pylist() for c in ("blob", "i", "j"))))
        for key, node, content in zip(keys, b.column("node").to_pylist(), contents(b)):
            if key != now:
                edges += flush(group)
                now, group = key, {}
            group[node] = content
        yield batch(edges)
    yield batch(flush(group))


def verified(meet: DataFrame, *, width: int, percent: int, k: int, floor: float) -> DataFrame:
    """(a, b): forests of the links among the classes that meet in a group (blob, i, j, node, and text or set)."""
    placed = meet.repartition("blob", "i", "j").sortWithinPartitions("blob", "i", "j", "node")
    return placed.mapInArrow(lambda batches: _forests(batches, width, percent, k, floor), "a long, b long")


def large_links(large: DataFrame, sets: DataFrame, heat: DataFrame, check: dict, block: int, block_shingles: int, leaders: int) -> DataFrame:
    """(a, b): forests of the links in large blobs, in blocks with leaders, then of the outsiders with all blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / block_shingles)).cast("long")
    dealt = large.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(heat, "node", "left")
    dealt = written(dealt.select("node", "blob", "blocks", "i", F.coalesce(-F.col("heat"), F.lit(0)).alias("cold")), "dealt")
    # The class of each block that has the most hot values, then the most of these: no task sees a whole blob.
    typical = dealt.groupBy("blob", "i", "blocks").agg(F.min(F.struct("cold", "node")).alias("t")).groupBy("blob", "blocks").agg(F.slice(F.array_sort(F.collect_list("t")), 1, leaders).alias("ts"))
    led = typical.select("blob", "blocks", F.explode("ts.node").alias("node")).select("blob", "node", every("blocks").alias("i"))
    meet = dealt.select("blob", "node", "i").unionByName(led).distinct().withColumn("j", F.lit(0).cast("long"))
    first = written(verified(meet.join(sets, "node"), **check), "forest")
    labelled = written(dealt.join(component_labels(first), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    main = labelled.groupBy("blob", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("blob").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = written(labelled.join(small(written(main, "main"), 1_000_000), "blob").where("root <> main").select("blob", "blocks", "node"), "outside")
    few = written(outside.groupBy("blob").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("few")), "few")
    many = small(few.where("few > 1").select("blob"), 1_000_000)
    stay = dealt.select("blob", "blocks", "i", "node")
    if not many.isEmpty():
        # Of a blob with many outsiders only the classes that can have a link go on.
        able = written(lonely_shares(sets.join(dealt.join(many, "blob", "left_semi").select("node"), "node", "left_semi"), check["percent"]).select("node"), "able")
        only = lambda d: d.join(many, "blob", "left_anti").unionByName(d.join(many, "blob", "left_semi").join(able, "node", "left_semi").select(d.columns))
        stay, outside = only(stay), written(only(outside), "outside")
        few = written(outside.groupBy("blob").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("few")), "few")
    few = small(few, 1_000_000)
    rows = outside.join(few, "blob").select("blob", F.pmod(F.xxhash64("node"), F.col("few")).alias("i"), every("blocks").alias("j"), "node")
    columns = stay.join(few, "blob").select("blob", every("few").alias("i"), F.col("i").alias("j"), "node")
    return first.unionByName(verified(rows.unionByName(columns).distinct().join(sets, "node"), **check))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = 48, hot: int = 64, floor: float = 0.4, block: int = 256, block_shingles: int = 1 << 21, leaders: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, key, n_shingles, component_id) for each row: key is xxhash64 of the text, component_id the least id reachable.

    Texts are read twice; the second time only those of one member of each class in
    a blob go on, as sets. A group that is verified in one task has at most two
    blocks of about `block` classes and `block_shingles` shingles.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rows, classes = told_apart(written(with_sketches(plain, "text", width, k).drop("text"), "sketches"))
    check = {"width": width, "percent": percent, "k": k, "floor": floor}
    zero = F.lit(0).cast("long")
    fits = (F.col("members") <= block) & (F.col("shingles") <= block_shingles)
    links, heat = candidate_links(classes, hot, floor)
    members = written(sized_blobs(classes, links), "members")
    chosen = members.where(fits).select("node", "blob", zero.alias("i"), zero.alias("j")).join(classes.select("node", "one"), "node")
    forest = verified(class_texts(plain, rows, written(chosen, "chosen"), broadcast_rows), **check)
    large = members.where(~fits)
    if not large.isEmpty():
        texts = class_texts(plain, rows, written(large.select("node").join(classes.select("node", "one"), "node"), "chosen"), broadcast_rows)
        as_sets = lambda got: [[s.view(np.int64) for s in shingle_sets(got[0], width)]]
        sets = written(add_columns(texts, ["text"], T.StructType([T.StructField("set", T.ArrayType(T.LongType()))]), as_sets).drop("text"), "sets")
        forest = forest.unionByName(large_links(large, sets, heat, check, block, block_shingles, leaders))
    labels = written(component_labels(forest).join(classes.select("node", "least"), "node"), "labels")
    over = hot_bound(labels.count())
    groups = labels.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    merged = join_groups(labels, groups, ["root"], "classes", over).select("node", "component_id")
    known = written(classes.select("node", "copies", "least").join(merged, "node", "left").select("node", "copies", F.coalesce("component_id", "least").alias("component_id")), "known")
    out = ["doc_id", "key", "n_shingles"]
    full = join_groups(rows.where("node is not null").select(*out, "node"), known, ["node"], "copies", hot_bound(rows.count()))
    return full.select(*out, "component_id").unionByName(rows.where("node is null").select(*out, F.col("doc_id").alias("component_id")))
