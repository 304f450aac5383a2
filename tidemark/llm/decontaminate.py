"""Benchmark decontamination by Wu-Manber search over words.

A text's words are the runs of ASCII letters, digits and non-ASCII characters
after lower-casing A-Z. Every window of `width` consecutive words of an item is
a pattern; an item of fewer words, but not none, is one pattern.

Defined cases: null and empty texts have no words; repeated items and windows
count once; items with a null id mark words but are not listed; an empty item
table marks nothing; repeated document rows stay repeated.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns
from tidemark.plans.lineage import written

#: Bytes 0-9, a-z and those of non-ASCII characters stay, A-Z become a-z, others a space.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Many word sequences searched at once.

    For patterns of one length m, the shift table holds for a block of two words
    how far the search may move on: m - 1 where no pattern contains the block,
    else the least distance of the block from a pattern's end. At shift 0 the
    bucket of that suffix block selects, by their first two words, the few
    patterns that are compared directly.
    """

    def __init__(self, patterns: dict[bytes, list]):
        by_length = defaultdict(list)
        for text, ids in patterns.items():
            p = tuple(text.split(b" "))
            by_length[len(p)].append((p, ids))
        self.single = {p[0]: ids for p, ids in by_length.pop(1, [])}
        self.groups = []
        for m, group in by_length.items():
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
            for p, ids in group:
                for j in range(m - 1):
                    block, far = p[j : j + 2], m - 2 - j
                    if shift.get(block, m) > far:
                        shift[block] = far
                buckets[p[-2:]][p[:2]].append((p, ids))
            self.groups.append((m, shift, buckets))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """Start, end and ids of each occurrence."""
        if self.single:
            for i, w in enumerate(text):
                if w in self.single:
                    yield i, i + 1, self.single[w]
        for m, shift, buckets in self.groups:
            i, n, get = m - 1, len(text), shift.get
            while i < n:
                far = get((text[i - 1], text[i]), m - 1)
                if far:
                    i += far
                    continue
                start = i - m + 1
                for p, ids in buckets[text[i - 1], text[i]].get((text[start], text[start + 1]), ()):
                    if tuple(text[start : i + 1]) == p:
                        yield start, i + 1, ids
                i += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_matchers: dict[str, WuManber] = {}


def _matcher(key: str, patterns) -> WuManber:
    """This worker's matcher of a pattern block; the one of another block is let go."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = WuManber(patterns.value)
    return _matchers[key]


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (pattern, item): the pattern's words joined by a space, the id as a string."""

    def run(batches):
        for b in batches:
            pairs = set()
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = words(text)
                pairs |= {(b" ".join(w[i : i + width]), item) for i in range(max(1, len(w) - width + 1)) if w}
            pairs = list(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], names=["pattern", "item"])

    plain = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "pattern binary, item string").distinct()


def mark_overlaps(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block: int = 100_000) -> DataFrame:
    """Add n_words, hits (disjoint ascending word spans) and items (sorted ids, as strings).

    Patterns go to the tasks in blocks of about `block` (pattern, item) pairs, so
    that a task's tables stay bounded however large the benchmark is. Each block is
    one more pass in the same stage, and no text is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    pairs = written(item_windows(items, width, item_id, item_text), "patterns")
    blocks = max(1, math.ceil(pairs.count() / block))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    adds = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", span), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs
    for k in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k)
        patterns: dict[bytes, list] = defaultdict(list)
        for row in own.toLocalIterator():
            patterns[bytes(row.pattern)].append(row.item)
        shared, key = sc.broadcast(dict(patterns)), uuid.uuid4().hex

        def function(got, shared=shared, key=key, first=k == 0):
            find = _matcher(key, shared).search
            columns = [[], [], []]
            for i, text in enumerate(got[0]):
                w = words(text)
                spans = [] if first else [(s["start"], s["end"]) for s in got[1][i]]
                ids = set() if first else set(got[2][i])
                for a, b, found in find(w):
                    spans.append((a, b))
                    ids.update(x for x in found if x is not None)
                for column, x in zip(columns, (len(w), [{"start": a, "end": b} for a, b in merged(spans)], sorted(ids))):
                    column.append(x)
            return columns

        out = add_columns(out, [text_col] if k == 0 else [text_col, "hits", "items"], adds, function)
    return out
