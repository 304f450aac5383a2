"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. An archive begins with a warcinfo record
of a random id, which all its records name in their headers and the manifest has. A
reading task scans its byte range for the gzip magic and takes the first candidate
whose decoded header names that id; an archive that a payload carries, compressed or
not, has another. It owns the records that start inside its range; the last one may
end beyond it. A member that begins as one and does not decode is damage and fails
the job.

Archives of other writers, of which the manifest has no id, are read too. There a
candidate with a WARC header is taken if the chain of members from it holds up to
the range's end: each has the length that its header states, and behind it stands
another member or nothing. An archive that a payload carries uncompressed is such a
chain only up to the payload's end, where the search goes on.

Files are opened with pyarrow's file systems by URI, on executors only; they lie
in the shared folder. A task writes to a name of its own attempt and the
manifest, a table committed by Spark, lists the files of successful attempts, so
that lost executors and repeated attempts leave no doubled records.

Defined cases: a null payload is empty; a null url leaves the header out, control
characters in urls are percent-encoded; rows that share the least page_id of
equal payloads are all responses; a null page_id is never the least; an empty
table gives no records; other columns are left out, whatever their names; warcinfo
records are not returned. In an archive without id, an archive inside a payload is
entered where gzip stored it uncompressed and it fills all the rest of a range.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import new_folder, small, written

MAGIC, VERSION, HEAD = b"\x1f\x8b\x08", b"WARC/1.", 1024
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("header_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_info(info: str) -> bytes:
    """The first record of the archive of that id."""
    body = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {info}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, info: str | None = None) -> bytes:
    kind, body = ("revisit", b"HTTP/1.1 200 OK\r\n\r\n") if refers_to is not None else ("response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload)
    # The archive's id comes early, so that it lies in the first HEAD bytes however long the url is.
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}"] + ([f"WARC-Warcinfo-ID: {info}"] if info else [])
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    kind = fields["WARC-Type"]
    return number("Page-Id"), fields["WARC-Record-ID"], kind, fields.get("WARC-Target-URI"), number("Refers-To-Page-Id"), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"), payload if kind == "response" else None


def mark_revisits(pages: DataFrame, *, min_bytes: int = 100, broadcast_rows: int = 500_000) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    Only (digest, page_id) is shuffled; payloads are too where more than
    `broadcast_rows` payloads occur more than once.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = small(written(first.where("n > 1 and first is not null").drop("n"), "first-pages"), broadcast_rows)
    marked = rows.join(first, "digest", "left")
    return marked.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, level: int = 6) -> DataFrame:
    """Write an archive for each partition; the manifest: (path, bytes, records, info), info the archive's id."""
    folder = new_folder(marked.sparkSession, "warc")

    def member(record: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(record) + z.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, info = f"{uuid.uuid4().hex}.warc.gz", f"<urn:uuid:{uuid.uuid4()}>"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            first = member(build_info(info))
            out.write(first)
            size, n = len(first), 0
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    record = member(build_record(*row, info))
                    out.write(record)
                    size, n = size + len(record), n + 1
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n], "info": [info]})

    manifest = written(marked.mapInArrow(run, "path string, bytes long, records long, info string"), "manifest")
    return manifest.select(F.concat(F.lit(folder + "/"), "path").alias("path"), "bytes", "records", "info")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI; names that only Hadoop's connectors use are put as pyarrow has them."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def members_from(file, at: int, piece: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and decoded bytes of the gzip members from a place on, as long as another follows."""
    file.seek(at)
    data = b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            data = data or file.read(piece)
            if not data:
                if used:
                    raise EOFError("the archive ends inside a record")
                return
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield at, at + used, b"".join(parts)
        at += used
        if len(data) < len(MAGIC):
            data += file.read(piece)
        if data and not data.startswith(MAGIC):
            return


def complete(record: bytes) -> bool:
    """Whether a decoded member is one record of the length that its header states."""
    head, found, rest = record.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\nContent-Length: *([0-9]+)(?:\r\n|$)", head)
    return bool(record.startswith(VERSION) and found and length) and len(rest) == int(length[1]) + 4


def chain_end(file, at: int, end: int) -> tuple[int, bool]:
    """Where the chain of members from a candidate stops, and whether it holds up to `end` or the file's end."""
    reached = at
    for _, reached, record in members_from(file, at):
        if not complete(record):
            return reached, False
        if reached >= end:
            return reached, True
    file.seek(reached)
    return reached, not file.read(1)


def first_record(file, start: int, end: int, info: str | None = None) -> int | None:
    """The start of the first member in [start, end) that belongs to the archive itself, which `info` names if it is known."""
    file.seek(start)
    window, i = file.read(end - start + 4096), 0
    mark = f"\r\nWARC-Warcinfo-ID: {info}\r\n".encode()
    while (i := window.find(MAGIC, i, end - start + len(MAGIC) - 1)) >= 0:
        try:
            head = zlib.decompressobj(31).decompress(window[i : i + 4096], HEAD).partition(b"\r\n\r\n")[0] + b"\r\n"
        except zlib.error:
            head = b""
        likely = head.startswith(VERSION)
        if likely and (start + i == 0 or (info and mark in head)):
            return start + i
        reached = start + i
        if likely and not info:
            reached, holds = chain_end(file, start + i, end)
            if holds:
                return start + i
        i = max(i + 1, reached - start)
    return None


def records_from(file, start: int, end: int, info: str | None = None, piece: int = 1 << 16) -> Iterator[bytes]:
    """The decoded records of a seekable archive that start in [start, end)."""
    first = first_record(file, start, end, info)
    if first is None:
        return
    for at, _, record in members_from(file, first, piece):
        if at >= end:
            return
        yield record


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives (path, bytes, and info where it is known), read in byte ranges of `split_bytes`."""
    info = F.col("info") if "info" in manifest.columns else F.lit(None).cast("string").alias("info")
    splits = manifest.where("bytes > 0").select("path", "bytes", info, F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    # A given number of partitions: adaptive execution would merge these few short rows into one task.
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"), "info").repartition(max(1, min(int(n), 100_000)))
    names = RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path, start, end, info in zip(*(c.to_pylist() for c in b.columns)):
                store, at = open_store(path)
                rows, size = [], 0
                with store.open_input_file(at) as file:
                    for record in map(parse_record, records_from(file, start, end, info)):
                        if record[2] == "warcinfo":
                            continue
                        rows.append(record)
                        size += len(record[6] or b"") + 1024
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return splits.mapInArrow(run, RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes and payload_digest; a revisit has those of the response it names."""
    read = records.select("page_id", "record_type", "refers_to", "header_digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    read = written(read, "records")
    full = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    revisit = read.where("record_type = 'revisit'").join(full, ["refers_to", "header_digest"], "left")
    revisit = revisit.select("page_id", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.when(F.col("_bytes").isNotNull(), F.col("header_digest")).alias("payload_digest"))
    return read.where("record_type = 'response'").select(*revisit.columns).unionAll(revisit)
