"""Ranked lexical search, term at a time with limited accumulators.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Documents are read once for all queries of a block: a task counts each text's terms
and keeps those that a query of the block has. That table of postings is written,
and from it come the number of documents N, their terms L and each term's document
frequency. Then each task takes its documents in shards of up to `shard_postings`
postings, inverts a shard into lists by term, and answers each query on it:

- the query's terms are taken rarest first; a term's list adds its share of the
  score to the accumulators of its documents, or creates them;
- before each term the bound of what is left (each term's largest share in the
  shard) is held against the k-th best score so far, of full scores of earlier
  shards or partial ones of this: where no document without an accumulator can
  still reach it, no more are created, and accumulators that can't reach it go;
- survivors are updated exactly, by looking their documents up in the lists.

A task hands on `k` documents a query at most, and these are ranked. All is in
whole numbers but the weight of a term, so results don't depend on shards or tasks.

Queries are taken in blocks of up to `block_terms` distinct terms, which alone
are sent to the tasks; the corpus is read once a block. Nothing is capped.

Defined cases: null and empty texts have no terms, so such documents are never
found and are not in N; such queries find nothing; repeated documents and queries
are rows of their own; equal scores are in order of id, null ids last; an empty
table gives no rows; a query whose terms are in no document has none; other columns
are left out, whatever their names. Very long texts are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import written

#: Non-ASCII characters have only bytes above 0x7F in UTF-8, so the patterns work on bytes.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_lists(text: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's terms in order, as lists for pieces of about `piece` bytes, cut between terms."""
    text, low = text or b"", 0
    while low < len(text):
        cut = _GAP.search(text, low + piece)
        high = cut.start() if cut else len(text)
        yield _TERM.findall(text[low:high].lower())
        low = high


def count_terms(text: bytes | None, number=lambda term: term) -> tuple[int, Counter]:
    """How many terms a text has, and their counts by what `number` makes of them, without None."""
    n, counts = 0, Counter()
    for found in term_lists(text):
        n += len(found)
        counts.update(map(number, found))
    counts.pop(None, None)
    return n, counts


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """Queries (id, counts of terms) in blocks of up to `block_terms` distinct terms, or one query that has more."""
    block, seen = [], set()
    for row in queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        _, counts = count_terms(row["text"] and bytes(row["text"]))
        if not counts:
            continue
        if block and len(seen | counts.keys()) > block_terms:
            yield block
            block, seen = [], set()
        block.append((row["id"], counts))
        seen |= counts.keys()
    if block:
        yield block


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: all its terms counted, those with a number listed."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                n, counts = count_terms(text, wanted.get)
                if not n:
                    continue
                ids.append(i)
                ns.append(n)
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int32())), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def frequencies(posted: DataFrame, n_terms: int) -> list[int]:
    """Each term's document frequency; a task sums its own documents first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    out = [0] * n_terms
    for row in posted.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Documents of a task as inverted lists: places of documents, and what the term adds to their scores."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_all: int):
        self.size = len(n)
        length = 100 - 75 + (75 * n * n_docs) // n_all
        doc = np.repeat(np.arange(len(n)), ends)
        share = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * length[doc]))
        order = np.argsort(terms, kind="stable")
        self.terms, start = np.unique(terms[order], return_index=True)
        self.start = np.append(start, len(terms))
        self.doc, self.share = doc[order], share[order]
        self.most = np.maximum.reduceat(self.share, start) if len(start) else np.zeros(0, np.int64)

    def best(self, query: list[tuple[int, int]], k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and full scores of all documents that can be among the k best; `query` is (term, times) rarest first, `reach` the k-th best score of earlier shards."""
        at = np.searchsorted(self.terms, [t for t, _ in query])
        lists = [(i, times) for (t, times), i in zip(query, at.tolist()) if i < len(self.terms) and self.terms[i] == t]
        left = sum(int(self.most[i]) * times for i, times in lists)
        score, creating = np.zeros(self.size, np.int64), True
        alive = np.zeros(0, np.int64)
        for i, times in lists:
            if creating and left < max(reach, kth(score, k) if left <= score.max(initial=0) else 0):
                creating, alive = False, np.flatnonzero(score)
            low, high = self.start[i], self.start[i + 1]
            doc = self.doc[low:high]
            if creating:
                score[doc] += times * self.share[low:high]
            else:
                now = score[alive]
                alive = alive[now + left >= max(reach, np.partition(now, -k)[-k] if len(now) >= k else 0)]
                place = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                hit = doc[place] == alive
                score[alive[hit]] += times * self.share[low:high][place[hit]]
            left -= int(self.most[i]) * times
        found = np.flatnonzero(score) if creating else alive
        enough = max(reach, kth(score[found], k), 1)
        found = found[score[found] >= enough]
        return found, score[found]


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


class Leaders:
    """The k best (score, id) a query so far; of equal scores the least ids, null last."""

    def __init__(self, k: int):
        self.k, self.rows, self.reach = k, [], 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[: self.k]
        self.reach = self.rows[-1][0] if len(self.rows) == self.k else 0


def shard_leaders(posted: DataFrame, queries: list[list[tuple[int, int]]], weights: list[int], n_docs: int, n_all: int, k: int, shard_postings: int) -> DataFrame:
    """(query, doc_id, score): of each task and query the k best documents."""
    shared = posted.sparkSession.sparkContext.broadcast((queries, np.array(weights, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shared.value
        leaders = [Leaders(k) for _ in asked]

        def answer(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            terms, ends = t.column("terms").combine_chunks(), t.column("n").to_numpy()
            shard = Shard(ends, np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy(), w, n_docs, n_all)
            ids = t.column("doc_id")
            for query, top in zip(asked, leaders):
                found, scores = shard.best(query, k, top.reach)
                if len(found):
                    top.add(scores, ids.take(pa.array(found)).to_pylist())

        parts, size, kind = [], 0, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            parts.append(b)
            size += len(b.column("terms").flatten())
            if size >= shard_postings:
                answer(parts)
                parts, size = [], 0
        if parts:
            answer(parts)
        if kind is not None:
            rows = [(q, i, s) for q, top in enumerate(leaders) for s, i in top.rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    kind = posted.schema["doc_id"].dataType.simpleString()
    return posted.mapInArrow(run, f"query int, doc_id {kind}, score long")


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10, block_terms: int = 200_000, shard_postings: int = 4_000_000) -> DataFrame:
    """(query id, rank, doc_id, score): of each query row the k documents of the highest scores above 0."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long"
    results = []
    for block in query_blocks(queries, query_id, query_text, block_terms):
        numbers = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
        posted = written(postings(plain, numbers), "postings")
        n_docs, n_all = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = frequencies(posted, len(numbers))
        weights = [weight(n_docs, f) for f in df]
        # Terms of weight 0 add nothing.
        asked = [sorted(((numbers[t], c) for t, c in counts.items() if df[numbers[t]] and weights[numbers[t]]), key=lambda q: (df[q[0]], q[0])) for _, counts in block]
        led = shard_leaders(posted, asked, weights, n_docs, n_all, k, shard_postings)
        # A task's rows meet by query in 64 parts first, so no task gets the rows of all tasks for a query.
        best = _top(_top(led.withColumn("part", F.spark_partition_id() % 64), ["query", "part"], k).drop("rank"), ["query"], k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item {queries.schema[query_id].dataType.simpleString()}")
        results.append(best.join(F.broadcast(names), "query").select(F.col("item").alias(query_id), "rank", F.col("doc_id").alias(id_col), "score"))
    if not results:
        return spark.createDataFrame([], kinds)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
