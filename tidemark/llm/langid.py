"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is
cut greedily into the longest phrases that occur in that text; the phrases,
times the bits that name a place in it, per byte of the document, estimate the
cross entropy. The language with the least estimate wins.

Bound: `rows` labelled rows a language (those with the least hash of the id) and
`sample_bytes` bytes of their concatenated normalised text train the model; the
automata have at most twice as many states. Classified texts are read whole.

Normal form: ASCII letters in lower case, bytes of other characters as they are,
anything else a space. All cells of `CELL` bytes of a batch are parsed in step, each
from the start state; then each cell is followed again from the state in which the
cell before it ended, until both parses are in one state, behind which they are
the same. So phrases cross the borders of cells, and results don't depend on them.

Defined cases: null, empty and letterless texts get `und` and score 0; rows with
a null text or label train nothing; without any training rows every text gets
`und`; ties go to the alphabetically first language; repeated rows are judged
alike.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

CELL = 512
_NORMAL = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], dtype=np.uint8)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root and every path spells a substring."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class CrossParser:
    """One language's automaton as a dense table over the bytes that its text has.

    An entry is twice the row of the next state, plus 1 where a phrase ends before
    the byte and the next one begins with it. The last row is that of the start and
    of what follows a byte that the text lacks, which is a phrase of its own.
    """

    def __init__(self, text: bytes):
        step = suffix_automaton(text)
        seen = sorted(set(text))
        self.width = len(seen) + 1
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.start = self.width * len(step)
        root = np.array([2 * self.width * step[0][c] + 1 for c in seen] + [2 * self.start + 1], np.int64)
        self.table = np.tile(root.astype(np.int32), (len(step) + 1, 1))
        for row, edges in zip(self.table, step):
            for c, to in edges.items():
                row[self.symbol[c]] = 2 * self.width * to
        self.table = self.table.ravel()
        self.bits = math.log2(len(text) + 1)

    def phrases(self, cells: np.ndarray, active: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each cell. cells: [byte, cell], cells by falling length; active: cells with that many bytes or more; before: the cell before each in its text, or -1."""
        n_cells = cells.shape[1]
        state, size = np.full(n_cells, self.start), np.zeros(n_cells, np.int64)
        states, begins = np.empty(cells.shape, np.int32), np.zeros(cells.shape, np.int8)
        for k, (row, n) in enumerate(zip(cells, active)):
            got = self.table[state[:n] + self.symbol[row[:n]]]
            begins[k, :n] = got & 1
            state[:n] = got >> 1
            states[k, :n] = state[:n]
            size[:n] += 1
        behind = np.full(n_cells, -1)
        behind[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            own, now, k, ran_out = todo, state[before[todo]], 0, []
            while len(own):
                got = self.table[now + self.symbol[cells[k, own]]]
                now = got >> 1
                begins[k, own] = got & 1
                going = states[k, own] != now
                states[k, own] = now
                own, now, k = own[going], now[going], k + 1
                if len(own) and (over := size[own] == k).any():
                    # A cell that ends in another state than before: the next one is followed again.
                    state[own[over]] = now[over]
                    ran_out.append(own[over])
                    own, now = own[~over], now[~over]
            todo = behind[np.concatenate(ran_out)] if ran_out else np.zeros(0, np.int64)
            todo = todo[todo >= 0]
        return begins.sum(axis=0, dtype=np.int64)


def costs(texts: list[bytes], parsers: list[CrossParser]) -> np.ndarray:
    """Bits a byte of each non-empty text (rows) under each language (columns)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n_cells = -(-lengths // CELL)
    owner = np.repeat(np.arange(len(texts)), n_cells)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
    size = np.minimum(CELL, lengths[owner] - place * CELL)
    buffer = np.concatenate((_NORMAL[np.frombuffer(b"".join(texts), np.uint8)], np.full(CELL, 32, np.uint8)))
    begin = (np.cumsum(lengths) - lengths)[owner] + place * CELL
    order = np.argsort(-size, kind="stable")
    cells = buffer[begin[order][None, :] + np.arange(int(size.max()))[:, None]]
    active = np.searchsorted(-size[order], -np.arange(1, len(cells) + 1), side="right")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    before = np.where(place[order] > 0, rank[order - 1], -1)
    out = np.empty((len(texts), len(parsers)))
    for k, p in enumerate(parsers):
        total = np.bincount(owner[order], p.phrases(cells, active, before), len(texts))
        out[:, k] = total * p.bits / lengths
    return out


def training_sample(docs: DataFrame, *, train: Column, id_col: str, text_col: str, lang_col: str, rows: int, sample_bytes: int) -> dict[str, bytes]:
    """The bounded sample: normalised text by language. Only each task's first `rows` rows of a language are shuffled."""
    first = Window.partitionBy("lang").orderBy("h", "t")
    plain = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    plain = plain.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(F.col(text_col), 1, sample_bytes).alias("t"))
    out: dict[str, bytes] = defaultdict(bytes)
    got = plain.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows).orderBy("lang", "n")
    for r in got.toLocalIterator():
        if len(out[r.lang]) < sample_bytes:
            normal = bytes(_NORMAL[np.frombuffer(r.t.encode(), np.uint8)])
            out[r.lang] += b" ".join(normal.split()) + b" "
    return {k: v[:sample_bytes] for k, v in sorted(out.items()) if v.strip()}


_models: dict[str, list[CrossParser]] = {}


def identify_language(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 200, sample_bytes: int = 1 << 15) -> DataFrame:
    """Add lang_pred, score (1 minus the best cost over the second best, 0 to 1) and cost (bits a byte).

    `train` selects the rows that may be learnt from. The tasks get the sample
    texts, at most `sample_bytes` a language, and build the automata once a worker.
    """
    sample = training_sample(docs, train=train, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows, sample_bytes=sample_bytes)
    names, key = list(sample), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(list(sample.values()))

    def function(got):
        if key not in _models:
            _models.clear()
            _models[key] = [CrossParser(t) for t in shared.value]
        texts = got[0]
        lang, score, cost = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        real = [i for i, t in enumerate(texts) if has_letter(t)] if names else []
        # About 4 MB of cells at a time.
        start = 0
        while start < len(real):
            stop, size = start, 0
            while stop < len(real) and (size < 1 << 22):
                size += len(texts[real[stop]])
                stop += 1
            part = real[start:stop]
            bits = costs([texts[i] for i in part], _models[key])
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(part)), best]
            second = np.partition(bits, 1, axis=1)[:, 1] if len(names) > 1 else np.full(len(part), np.inf)
            for i, b, x, y in zip(part, best, least, second):
                lang[i], score[i], cost[i] = names[b], float(1 - x / y), float(x)
            start = stop
        return [lang, score, cost]

    adds = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cost", T.DoubleType())])
    return add_columns(docs, [text_col], adds, function)
