"""Sources: CSV with messy headers, several files with running row numbers, HTML tables, service maps."""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.lineage import new_folder
from tidemark.sources.split_csv import Table, csv_table, listed

#: Texts that count as missing, and default headers of the service map.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MAP_HEADERS = {"service_name": ("Service Name", "Service_Name"), "source_full_id": ("Source Full ID",), "source_service_id": ("Source Service ID", "Source_Service_ID"), "target_service_id": ("Target Service ID", "Target_Service_ID")}


def _cells(table: Table) -> DataFrame:
    """All cells as texts, null as blank, "1.0" as "1"; with _file and _record."""
    return table.rows.select(*(text.whole_number(F.coalesce(text.col(c), F.lit(""))).alias(c) for c in table.columns), "_file", "_record")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All cells as texts, null as blank, headers trimmed, "1.0" as "1"; quotes may hold line ends, and many tasks read a file."""
    return _cells(csv_table(spark, [path] if isinstance(path, str) else path)).drop("_file", "_record")


def read_numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one: the first file's columns, row_num from 2 on over all files, child_name."""
    table = csv_table(spark, paths)
    before = list(itertools.accumulate((table.counts.get(f, 0) for f in range(len(table.files))), initial=0))
    shifts = spark.createDataFrame(list(enumerate(before[:-1])), "_file int, _before long")
    names = [c for c in table.heads[min(table.heads)] if c.lower() != "row_num"] if table.heads else []
    placed = _cells(table).join(F.broadcast(shifts), "_file")
    out = placed.select(*map(text.col, names), (F.col("_record") + F.col("_before") + 1).alias("row_num"))
    return out.withColumn("child_name", text.child_name()) if {"Child_First_Name", "Child_Last_Name"} <= set(names) else out


def _named_files(spark: SparkSession, table: Table) -> DataFrame:
    """All columns of all files, row_num from 2 on in each file, and source_file."""
    names = spark.createDataFrame([(f, table.files[f].rpartition("/")[2]) for f in table.heads], "_file int, source_file string")
    return _cells(table).withColumn("row_num", F.col("_record") + 1).join(F.broadcast(names), "_file").drop("_file", "_record")


def _has_parents(head: list[str]) -> bool:
    return any("_First_Name" in c for c in head)


def read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The files of existing services in a folder as one table: source_file, row_num, and the columns of any of them.

    Files without parents' names, which give no profile, and files that can't be read
    are left out, as `existing_and_rejected` says of each; None if all are.
    """
    return existing_and_rejected(spark, path)[0]


def existing_and_rejected(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """The table of read_existing, and (source_file, reason) of each file that was left out."""
    files = [r.path for r in input_files(spark, path).select("path").toLocalIterator()]
    table = csv_table(spark, files, usable=_has_parents, tolerant=True)
    rejected = [(f.rpartition("/")[2], why) for f, why in table.rejected]
    return _named_files(spark, table) if table.heads else None, spark.createDataFrame(rejected, "source_file string, reason string")


def html_columns(tables: DataFrame) -> DataFrame | None:
    """The rows of read_html_tables under their headers, source_file and row_num; None without any table.

    One branch for each list of headers that differs from the others.
    """
    heads = tables.where("line = 0").select("file", F.transform("cells", lambda c: F.trim(c)).alias("head"))
    out = None
    for (head,) in heads.select("head").distinct().toLocalIterator():
        mine = tables.where("line > 0").join(heads.where(F.col("head") == F.array(*map(F.lit, head))).select("file"), "file", "left_semi")
        cells = [F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")).alias(h) for i, h in enumerate(head)]
        part = mine.select(*cells, F.element_at(F.split("file", "/"), -1).alias("source_file"), (F.col("line") + 1).alias("row_num"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.fillna("") if out is not None else None


def read_balances(spark: SparkSession, path: str) -> DataFrame | None:
    """The balance files of a folder as one table: CSV by its name, HTML tables by content, other files left out."""
    files = [r.path for r in input_files(spark, path).select("path").toLocalIterator()]
    csv = [f for f in files if f.lower().endswith(".csv")]
    other = [f for f in files if not f.lower().endswith(".csv")]
    parts = [_named_files(spark, csv_table(spark, csv))] if csv else []
    if other and (html := html_columns(read_html_tables(spark, other))) is not None:
        parts.append(html)
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.fillna("") if out is not None else None


def read_bookings(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The union of booking files in exactly these columns, and src_row from 0 on over all files."""
    rows = read_numbered(spark, paths).withColumn("src_row", F.col("row_num") - 2)
    return project(rows, columns, "src_row")


def project(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Exactly these columns: absent ones blank, missing-value texts blank; and the columns `keep` as they are."""
    cells = ((F.when(F.coalesce(text.col(c), F.lit("")).isin(*MISSING), "").otherwise(text.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns)
    return df.select(*cells, *keep)


def read_service_map(spark: SparkSession, path: str, headers: dict[str, tuple[str, ...]] = MAP_HEADERS) -> DataFrame:
    """service_name, source_full_id, source_service_id, target_service_id and map_ord; each from the first of its `headers` that the file has."""
    df = _cells(csv_table(spark, [path]))
    named = {k: next((h for h in hs if h in df.columns), None) for k, hs in headers.items()}
    return df.select(*((text.strip(h) if h else F.lit("")).alias(k) for k, h in named.items()), (F.col("_record") - 1).alias("map_ord"))


def service_map_of(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """A service map of literal (name, full source id, source id, target id); blank targets are left out."""
    rows = [(*e, i) for i, e in enumerate(entries) if e[3].strip()]
    return spark.createDataFrame(rows, "service_name string, source_full_id string, source_service_id string, target_service_id string, map_ord long")


class _FirstTable(HTMLParser):
    """The cells of a page's first table, row by row."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.state = 0  # 0 before, 1 in, 2 after the table

    def handle_starttag(self, tag, attrs):
        if tag == "table" and self.state == 0:
            self.state = 1
        elif self.state == 1 and tag == "tr":
            self.rows.append([])
        elif self.state == 1 and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.state == 1:
            self.state = 2
        elif tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


class _Page:
    """One file's first table, fed in pieces: rows (file, line, cells, reason) as soon as they are complete."""

    def __init__(self, file: str, size: int):
        self.file, self.left, self.line = file, size, 0
        self.head, self.known, self.html = b"", False, False
        self.parser, self.decode = _FirstTable(), codecs.getincrementaldecoder("utf-8")("replace").decode

    def feed(self, tokens: list[bytes]) -> list[tuple]:
        """Tokens that each end with ">", which they lack; the file's last one may end without."""
        self.left -= sum(map(len, tokens)) + len(tokens)
        data = self.head + b">".join(tokens) + (b">" if self.left >= 0 else b"")
        if self.known or len(data) >= 512:
            self._take(data)
        else:
            self.head = data
        return self._rows(0 if self.parser.state == 2 else 1)

    def _take(self, data: bytes) -> None:
        if not self.known:
            self.known, self.html, self.head = True, b"<" in data[:512] and b">" in data[:512], b""
        if self.html and self.parser.state < 2:
            self.parser.feed(self.decode(data))

    def close(self) -> list[tuple]:
        self._take(self.head)
        rows = self._rows(0)
        return rows if self.line else [(self.file, None, None, "no table" if self.html else "not HTML")]

    def _rows(self, open_rows: int) -> list[tuple]:
        done = self.parser.rows[: len(self.parser.rows) - open_rows]
        del self.parser.rows[: len(done)]
        full = [r for r in done if r]
        self.line += len(full)
        return [(self.file, self.line - len(full) + i, r, None) for i, r in enumerate(full)]


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file", "line", "cells", "reason"])

    page = None
    for b in batches:
        out = []
        tokens = zip(*(b.column(c).to_pylist() for c in ("file", "size", "value")))
        for (file, size), run in itertools.groupby(tokens, key=lambda t: t[:2]):
            if page is None or page.file != file:
                out += page.close() if page else []
                page = _Page(file, size)
            out += page.feed([t[2] for t in run])
        yield batch(out)
    yield batch(page.close() if page else [])


def html_and_rejected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, cells, reason): the first table of each file, and a row with a reason for each file that has none.

    A file's tokens, up to each ">", stream through one task, so memory holds one batch
    of them however large the file is. line 0 holds the headers. Files of which the first
    512 bytes do not look like HTML are left out as "not HTML", pages without a row of
    cells as "no table"; a table that is cut off has the rows that are complete, and
    bytes that are no UTF-8 are replaced. Files without any byte are "empty".
    """
    found = list(dict.fromkeys(listed(spark, [path] if isinstance(path, str) else path)))
    schema = "file string, line long, cells array<string>, reason string"
    empty = spark.createDataFrame([(shown, None, None, "empty") for _, shown, n in found if not n], schema)
    sizes = [n for _, _, n in found if n]
    if not sizes:
        return empty
    # Ranges of whole files: none is cut, and small ones share a task.
    whole = max(*sizes, min(128 << 20, sum(sizes) // spark.sparkContext.defaultParallelism), 1)
    own = spark.newSession()
    for key, value in {"maxPartitionBytes": whole, "minPartitionNum": 1, "openCostInBytes": whole // 32 + 1}.items():
        own.conf.set(f"spark.sql.files.{key}", str(value))
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f, _, n in found if n]
    tokens = own.read.option("lineSep", ">").text(names).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    # Written by that session, as a plan of another would cut the files by its own settings.
    folder = new_folder(spark, "pages")
    tokens.mapInArrow(_page_rows, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder).unionByName(empty)


def read_html_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, cells) of the first table of each file whose first bytes look like HTML; line 0 holds the headers."""
    return html_and_rejected(spark, path).where("reason is null").drop("reason")


def input_files(spark: SparkSession, path: str, excluded: str = "serviceids.csv") -> DataFrame:
    """(path, name, bytes) of a folder's files in order of name, without the service map."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return files.where(F.lower("name") != excluded).orderBy("name")

