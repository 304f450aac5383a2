"""Quoted CSV read by many tasks a file.

A line end inside a quoted cell is no record's end, and whether a byte range starts
inside a quoted cell depends on all text before it. Files are read as lines by
Spark's own ranges, twice:

1. Each task follows its ranges' lines under both states, outside and inside a quoted
   cell, and says for each range how each state leaves it and how many records start
   in it. The ranges' answers in order of place, a row for each of at most some
   hundred thousand ranges, give each range's true state and its first record's number.
2. Each task cuts its ranges' lines into records. A range owns the records that start
   in it. Of a record that goes on into later ranges each of these hands on its piece,
   and pieces meet by file and record number; nothing else is shuffled.

Records are written with their file and number, as pass 2 needs the very ranges of
pass 1, and are then parsed by Spark's CSV parser, so cells are what its reader gives.

Defined cases: lines end with \\n or \\r\\n, and inside cells stay as they are; empty
lines between records are none; a quote that doesn't start a cell is text; text behind
a closing quote belongs to the cell, which then ends at the next separator or line end;
a quoted cell that never ends takes the rest of its file, but for the last line end;
a byte order mark is dropped; a file without a record gives none; a file named
twice is read once. Short records have null cells, further cells are left out. Files
with NUL bytes or bytes that aren't UTF-8 are rejected, with the reason, or read as they are.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import new_folder

#: More ranges than this are not made: ranges grow with the files instead.
MOST_RANGES = 200_000
#: A range is followed by Python, so it is smaller than Spark's own of 128 MB: files of some ten MB have several tasks.
RANGE_BYTES = 16 << 20
BOM = b"\xef\xbb\xbf"
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _closed(line: bytes, at: int, sep: bytes) -> int:
    """Where the next cell starts after the quoted cell that `at` is inside of; -1 if the line ends inside it."""
    while True:
        quote = line.find(b'"', at)
        if quote < 0:
            return -1
        if line[quote + 1 : quote + 2] == b'"':
            at = quote + 2
            continue
        end = line.find(sep, quote + 1)
        return end + 1 if end >= 0 else len(line) + 1


def ends_inside(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a line leaves a quoted cell open, from its start inside or outside of one."""
    at = 0
    if inside:
        at = _closed(line, 0, sep)
        if at < 0:
            return True
    while at <= len(line):
        if line[at : at + 1] == b'"':
            at = _closed(line, at + 1, sep)
            if at < 0:
                return True
        else:
            end = line.find(sep, at)
            if end < 0:
                return False
            at = end + 1
    return False


class Lines:
    """Lines of a range, in order, and what each does to the two states: outside (False) and inside (True) of a quoted cell.

    Well-formed lines are told by patterns, all at once. Others are followed quote by
    quote, but only from a state in which they are reached.
    """

    def __init__(self, values: pa.Array, sep: bytes, first: bool):
        if first and len(values) and values[0].as_py().startswith(BOM):
            values = pa.concat_arrays([pa.array([values[0].as_py()[3:]], values.type), values[1:]])
        self.values = values
        self.full = ~pc.is_in(values, pa.array([b"", b"\r"], values.type)).to_numpy(zero_copy_only=False)
        self.quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
        self.out, self.in_ = np.zeros(len(values), bool), np.ones(len(values), bool)
        self.open, self.sep = [np.zeros(len(values), bool), np.zeros(len(values), bool)], sep
        some = values.take(pa.array(self.quoted))
        mark = re.escape(sep.decode())
        cell, open_ = f'(?:[^"{mark}]*|"(?:[^"]|"")*")', '"(?:[^"]|"")*'
        rest = f"(?:{mark}{cell})*"
        for after, inside, pattern in (
            (self.out, False, (f"^{cell}{rest}\r?$", f"^(?:{cell}{mark})*{open_}$")),
            (self.in_, True, (f'^(?:[^"]|"")*"{rest}\r?$', f'^(?:[^"]|"")*(?:"{rest}{mark}{open_})?$')),
        ):
            closed, opened = (pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False) for p in pattern)
            after[self.quoted] = opened
            self.open[inside][self.quoted] = ~closed & ~opened

    def _follow(self, places: np.ndarray, inside: bool) -> None:
        after = self.in_ if inside else self.out
        for k in np.flatnonzero(places).tolist():
            after[k] = ends_inside(_bare(self.values[k].as_py()), inside, self.sep)
        self.open[inside][places] = False

    def states(self, inside: bool) -> np.ndarray:
        """The state before each line and behind the last, if the first line starts `inside`."""
        for turn in itertools.count():
            found = self._composed(inside)
            reached = [self.open[0] & ~found[:-1], self.open[1] & found[:-1]]
            if not any(r.any() for r in reached):
                return found
            for s in (0, 1):
                self._follow(reached[s] if turn < 8 else self.open[s], bool(s))

    def _composed(self, inside: bool) -> np.ndarray:
        constant, swaps = self.out == self.in_, np.cumsum(self.out & ~self.in_)
        last = np.maximum.accumulate(np.where(constant, np.arange(len(self.out)), -1))
        since = np.where(last >= 0, swaps - swaps[last], swaps) % 2 == 1
        return np.concatenate(([inside], np.where(last >= 0, self.out[last], inside) ^ since))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """(its first row, lines) of each range of a batch, in order."""
    path, start = b.column("path").to_numpy(), b.column("start").to_numpy()
    edges = [0, *(np.flatnonzero((path[1:] != path[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), b.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        if high > low:
            yield low, b.column("value").slice(low, high - low)


def _bare(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


def _fault(values: pa.Array) -> str | None:
    """What tells that lines are no text."""
    if pc.any(pc.match_substring(values, "\0")).as_py():
        return "NUL bytes"
    try:
        values.cast(pa.string())
    except pa.ArrowInvalid:
        return "not UTF-8"
    return None


def _range_states(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    """For each range: whether it ends inside a cell, and how many records start in it, if it starts outside and if inside."""
    rows: list[list] = []
    for b in batches:
        for at, values in _runs(b):
            key = [b.column("path")[at].as_py(), b.column("start")[at].as_py()]
            new = not rows or rows[-1][:2] != key
            if new:
                rows.append([*key, False, True, 0, 0, None])
            row = rows[-1]
            row[6] = row[6] or _fault(values)
            lines = Lines(values, sep, new and key[1] == 0)
            for s in (0, 1):
                states = lines.states(row[2 + s])
                row[2 + s], row[4 + s] = bool(states[-1]), row[4 + s] + int((lines.full & ~states[:-1]).sum())
    names = ["path", "start", "end0", "end1", "n0", "n1", "fault"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _range_records(batches: Iterator[pa.RecordBatch], sep: bytes, ranges: dict) -> Iterator[pa.RecordBatch]:
    """(file, record, start, whole, text): whole records, and pieces of those that a range begins or ends within; `ranges` has (file, inside, first record) by path and start."""
    now, inside, record, held, owned = None, False, 0, [], True

    def rows_of(records: range | list[int], texts: list[bytes], whole: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int32()), pa.array(records, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array([whole] * n, pa.bool_()), pa.array(texts, pa.binary())], names=["file", "record", "start", "whole", "text"])

    for b in batches:
        for at, values in _runs(b):
            file, begins_inside, first = ranges[b.column("path")[at].as_py(), b.column("start")[at].as_py()]
            key = (file, b.column("start")[at].as_py())
            new = now != key
            if new:
                if held:
                    yield rows_of([record - 1], [b"\n".join(held)], False)
                now, held, inside, record = key, [], begins_inside, first
                owned = not inside
            lines = Lines(values, sep, new and key[1] == 0)
            states, out = lines.states(inside), lines.values.to_pylist()
            # A record goes from a line that starts outside to the next line that ends outside.
            starts, ends = np.flatnonzero(lines.full & ~states[:-1]).tolist(), (np.flatnonzero((lines.full | states[:-1]) & ~states[1:]) + 1).tolist()
            if inside:
                if not ends:
                    held += out
                    continue
                # The end of a record that this or, if it isn't owned, an earlier range began.
                yield rows_of([record - 1], [b"\n".join([*held, *out[: ends[0] - 1], _bare(out[ends[0] - 1])])], owned)
                held, ends = [], ends[1:]
            whole = [b"\n".join([*out[x : y - 1], _bare(out[y - 1])]) if y - x > 1 else _bare(out[x]) for x, y in zip(starts, ends)]
            if whole:
                yield rows_of(range(record, record + len(whole)), whole, True)
            record, inside = record + len(starts), bool(states[-1])
            if inside:
                held, owned = out[starts[-1] :], True
    if held:
        yield rows_of([record - 1], [b"\n".join(held)], False)


#: An empty host is spelled in two ways.
_HOST = r"^([A-Za-z0-9+.-]+):///"


@dataclass
class Records:
    """All records of some files: rows (file, record, text) by a file's place in `files` and the record's number from 0 on, the header's; how many each file has; and what tells that a file is no text."""

    rows: DataFrame
    files: list[str]
    counts: list[int]
    faults: list[str | None]


def listed(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, int]]:
    """Full name, the name as a column of Spark has it, and bytes of each file of a list of files, folders and patterns, in that order, a folder's by name; none is opened."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        store = where.getFileSystem(conf)
        found = store.globStatus(where)
        if found is None or not len(found):
            raise FileNotFoundError(p)
        for f in found:
            inner = sorted(store.listStatus(f.getPath()), key=lambda s: s.getPath().getName()) if f.isDirectory() else [f]
            out += [(s.getPath().toString(), re.sub(_HOST, r"\1:/", s.getPath().toUri().toString()), s.getLen()) for s in inner if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    return out


def csv_records(spark: SparkSession, paths: list[str], *, sep: str = ",", range_bytes: int = RANGE_BYTES) -> Records:
    """The records of files, folders' files and patterns, which are parsed by none of the passes."""
    found = list(dict.fromkeys(listed(spark, paths)))
    files, size = [f for f, _, _ in found], max(range_bytes, sum(n for _, _, n in found) // MOST_RANGES + 1)
    if not files:
        return Records(spark.createDataFrame([], "file int, record long, text string"), [], [], [])
    # Rows carry a file's name as a hash, as names would outweigh lines; an empty host is spelled in two ways.
    spelled = [(i, form) for i, (_, shown, _) in enumerate(found) for form in dict.fromkeys((shown, re.sub(r"^([A-Za-z0-9+.-]+):/(?!/)", r"\1:///", shown)))]
    order = {r.h: r.i for r in spark.createDataFrame(spelled, "i int, p string").select("i", F.xxhash64("p").alias("h")).collect()}
    if len(order) < len(spelled):
        raise ValueError("two of the files have names of one hash")
    # A session of its own, so that both passes cut the files alike, whatever the caller's settings and the number of executors.
    own = spark.newSession()
    for key, value in {"maxPartitionBytes": size, "minPartitionNum": 1, "openCostInBytes": size // 32 + 1}.items():
        own.conf.set(f"spark.sql.files.{key}", str(value))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    path, start = F.xxhash64("_metadata.file_path"), F.col("_metadata.file_block_start")
    # Names are names here, not patterns.
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]
    lines = own.read.option("lineSep", "\n").text(names).select(F.col("value").cast("binary").alias("value"), path.alias("path"), start.alias("start"))
    mark = sep.encode()
    states = lines.mapInArrow(lambda b: _range_states(b, mark), "path long, start long, end0 boolean, end1 boolean, n0 long, n1 long, fault string")
    ranges, counts, faults, inside, last = {}, [0] * len(files), [None] * len(files), False, None
    for r in sorted(states.collect(), key=lambda r: (order[r.path], r.start)):
        file = order[r.path]
        inside = inside and file == last
        ranges[r.path, r.start] = (file, inside, counts[file])
        inside, n = (r.end1, r.n1) if inside else (r.end0, r.n0)
        counts[file], faults[file], last = counts[file] + n, faults[file] or r.fault, file
    known = spark.sparkContext.broadcast(ranges)
    cut = lines.mapInArrow(lambda b: _range_records(b, mark, known.value), "file int, record long, start long, whole boolean, text binary")
    folder = new_folder(spark, "records")
    cut.withColumn("text", F.col("text").cast("string")).write.parquet(folder)
    kept = spark.read.schema("file int, record long, start long, whole boolean, text string").parquet(folder)
    pieces = kept.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    rows = kept.where("whole").select("file", "record", "text").unionByName(pieces.select("file", "record", F.array_join("p.text", "\n").alias("text")))
    return Records(rows, files, counts, faults)


def header_cells(text: str, sep: str = ",") -> list[str]:
    """A header's names: trimmed, blank ones by their place, of equal ones (in any case) each with its place behind it."""
    cells = [c.strip() for c in next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])]
    times = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if times[c.lower()] > 1 else c for i, c in enumerate(cells)]


@dataclass
class Table:
    """Rows under their headers with _file and _record, the files, each file's header and number of rows, and (file, reason) of those left out."""

    rows: DataFrame
    files: list[str]
    heads: dict[int, list[str]]
    counts: dict[int, int]
    rejected: list[tuple[str, str]]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("_file", "_record")]


def csv_table(spark: SparkSession, paths: list[str], *, sep: str = ",", range_bytes: int = RANGE_BYTES, usable=None, tolerant: bool = False) -> Table:
    """The rows of CSV files, each file under its own header.

    Columns are those of all headers, the first file's first; what a file lacks is null.
    Files of any headers are one plan: a row's cells are dealt out by its file's
    places. Files whose header is not `usable`, files without a record and, if `tolerant`,
    files that are no text are left out and named.
    """
    found = csv_records(spark, paths, sep=sep, range_bytes=range_bytes)
    faults = {i: f for i, f in enumerate(found.faults) if f and tolerant} | {i: "no record" for i, n in enumerate(found.counts) if not n}
    texts = {r.file: r.text for r in found.rows.where("record = 0").collect() if r.file not in faults}
    named = {t: header_cells(t, sep) for t in set(texts.values())}
    heads = {f: named[texts[f]] for f in sorted(texts)}
    if usable:
        faults |= {f: "header not usable" for f, h in heads.items() if not usable(h)}
        heads = {f: h for f, h in heads.items() if f not in faults}
    columns = list(dict.fromkeys(c for h in heads.values() for c in h))
    width = max((len(h) for h in heads.values()), default=0)
    rejected = [(found.files[i], why) for i, why in sorted(faults.items())]
    counts = {f: found.counts[f] - 1 for f in heads}
    own = [F.col("file").alias("_file"), F.col("record").alias("_record")]
    rows = found.rows.where("record > 0")
    if not width:
        return Table(rows.where("false").select(*own), found.files, heads, counts, rejected)
    if faults or len(named) > 1:
        places = [(f, [h.index(c) if c in h else None for c in columns]) for f, h in heads.items()]
        rows = rows.join(F.broadcast(spark.createDataFrame(places, "file int, at array<int>")), "file")
    parsed = rows.withColumn("c", F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), OPTIONS | {"sep": sep}))
    if "at" not in rows.columns:
        return Table(parsed.select(*(F.col(f"c.c{i}").alias(c) for i, c in enumerate(columns)), *own), found.files, heads, counts, rejected)
    cells = parsed.select("file", "record", "at", F.array(*(F.col(f"c.c{i}") for i in range(width))).alias("cells"))
    return Table(cells.select(*(F.get("cells", F.col("at")[k]).alias(c) for k, c in enumerate(columns)), *own), found.files, heads, counts, rejected)
