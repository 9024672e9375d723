"""WARC (6): an archive of pages and a two-level capture index over it.

Archive: each partition of pages becomes one file of gzip members: a warcinfo record,
then one WARC/1.1 response record for each page, with all mandatory fields (its id is
a UUID made from its file, place and content, its date is that of the archive). Index: capture lines (key, page id, file, offset, length,
digest) are range-partitioned and sorted by key, the URL with its host reversed;
each partition becomes one file of compressed blocks of BLOCK_LINES lines,
followed by its directory, the first key of every block. What the driver holds
is one row an index file (its first key), whose number is that of the shuffle
partitions and doesn't grow with the captures.

Lookup: keys are routed to their index file, sorted, binary-searched in its
directory, then in the block that a range read fetches; a second range read
fetches the record. All files lie in the shared folder and are read through
pyarrow's file systems, so they may be on a local disk, HDFS or an object store.
A file's name holds the task attempt that wrote it; only the lines of the attempt
that succeeded name it.

Defined results: null URLs are indexed under the empty key and null pages are
archived as empty; every row of pages is a capture, rows that repeat one too; a
key that has no capture gives no row; the files of a query (captures_of) are deleted
once its rows are written, those of archive() and build() are the caller's; fragments, schemes, ports, a leading www.
and the case of the host aren't part of a key; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import md5

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, filesystem, parts, portions, remove, scoped, share, shared_dir

BLOCK_LINES = 300


def url_key(url: Column) -> Column:
    """com,example,host)/path?query"""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), ":[0-9]*$", ""), "^(?i)www[.]", ""))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(key)


def _member(kind: str, date: str, name: str, fields: list[str], body: bytes) -> bytes:
    """A WARC record as one gzip member. name: what its id is made from."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", *fields, f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def info(date: str, file: str) -> bytes:
    """The record that opens a file."""
    return _member("warcinfo", date, file, [f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], b"software: folioscan\r\nformat: WARC File Format 1.1\r\n")


def record(url: str, page_id: int | None, html: bytes, date: str, place: str) -> bytes:
    """A response record. place: file and offset, so that rows that repeat have ids of their own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    digest = md5(html).hexdigest()
    # a target is mandatory; a page without a URL has its id for one
    target = re.sub(r"\s", "%20", url) or f"urn:page:{page_id}"
    return _member("response", date, f"{place}:{page_id}:{digest}", [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: md5:{digest}", "Content-Type: application/http;msgtype=response"], http)


def payload(member: bytes) -> bytes:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    return rest[:size].partition(b"\r\n\r\n")[2]


CAPTURES = "key string, page_id long, file string, offset long, length long, digest string"


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write the archive; capture rows and the folder."""
    spark = pages.sparkSession
    batches(spark)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            first = info(date, name)
            out.write(first)
            at = len(first)
            for batch in rows:
                for part in portions(batch, 3):
                    lines = []
                    for key, i, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        body = (html or "").encode("utf-8", "surrogatepass")
                        member = record(url or "", i, body, date, f"{folder}/{name}:{at}")
                        out.write(member)
                        lines.append((key, i, name, at, len(member), md5(body).hexdigest()))
                        at += len(member)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "page_id", "file", "offset", "length", "digest"])

    lines = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, CAPTURES)
    return cut(lines), folder


@dataclass
class CaptureIndex:
    folder: str
    archive: str
    firsts: list[str]  #: first key of each index file, in order
    files: list[str]


def build(captures: DataFrame, archive_folder: str) -> CaptureIndex:
    spark = captures.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        directory, at, held = [], 0, []
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:

            def flush() -> None:
                nonlocal at
                block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode("utf-8", "surrogatepass"), 6)
                out.write(block)
                directory.append((held[0][0], at, len(block)))
                at += len(block)
                held.clear()

            for batch in rows:
                for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(line)
                    if len(held) == BLOCK_LINES:
                        flush()
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + len(tail).to_bytes(8, "big"))
        if directory:
            yield pa.record_batch([pa.array([directory[0][0]]), pa.array([name])], names=["first", "file"])

    columns = ["key", "page_id", "file", "offset", "length", "digest"]
    ordered = captures.select(*columns).repartitionByRange(parts(spark), "key").sortWithinPartitions("key", "page_id", "file", "offset")
    made = sorted((r["first"], r["file"]) for r in ordered.mapInArrow(run, "first string, file string").collect())
    return CaptureIndex(folder, archive_folder, [f for f, _ in made], [f for _, f in made])


class Reader:
    """One index file: its directory in memory, blocks by range reads."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list] | None = None

    def block(self, i: int) -> list:
        if not self.held or self.held[0] != i:
            _, at, n = self.directory[i]
            raw = zlib.decompress(self.file.read_at(n, at)).decode("utf-8", "surrogatepass")
            self.held = (i, [json.loads(x) for x in raw.split("\n")])
        return self.held[1]

    def find(self, key: str) -> list[list]:
        """All capture lines of a key; they may begin in the block before the first that starts with it."""
        i = max(bisect_left(self.firsts, key) - 1, 0)
        out = []
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self.block(i)
            keys = [x[0] for x in lines]
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
            i += 1
        return out


FOUND = "page_id long, url_key string, n_captures long, html_md5 string, html_bytes long"


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """A row for each capture of each distinct key of keys (one string column): read from the archive."""
    spark: SparkSession = keys.sparkSession
    asked = keys.toDF("key").select(F.coalesce("key", F.lit("")).alias("key")).distinct()
    if not index.files:
        return spark.createDataFrame([], FOUND)
    ranges = share(spark, (index.firsts, index.files))
    folder, root_of_archive = index.folder, index.archive

    def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = ranges.value[0]
        for batch in rows:
            keys = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([max(bisect_right(firsts, k) - 1, 0) for k in keys], pa.int32())], names=["key", "at"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        store, base = filesystem(root_of_archive)
        at, reader, open_files = None, None, {}
        for batch in rows:
            out = []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    at, reader = i, Reader(fs, f"{root}/{ranges.value[1][i]}")
                lines = reader.find(key)
                for _, page, file, offset, length, digest in lines:
                    if file not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[file] = store.open_input_file(f"{base}/{file}")
                    body = payload(open_files[file].read_at(length, offset))
                    got = md5(body).hexdigest()
                    if got != digest:
                        raise ValueError(f"{file} at {offset}: the payload's digest is {got}, the index has {digest}")
                    out.append((page, key, len(lines), got, len(body)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url_key", "n_captures", "html_md5", "html_bytes"])

    routed = asked.mapInArrow(route, "key string, at int").repartitionById(len(index.files), F.col("at")).sortWithinPartitions("at", "key")
    return routed.mapInArrow(run, FOUND)


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive and index pages, then look every page's URL up; the archive and the index go once the rows are written."""
    with scoped():
        lines, folder = archive(pages)
        index = build(lines, folder)
        found = cut(lookup(index, pages.select(url_key(F.col("url")).alias("key"))))
    remove(folder)
    remove(index.folder)
    return found
