"""Shared plumbing: sessions, lineage cuts, safe column names, numpy text helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INV = U64(pow(int(BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most; Spark bounds its bytes besides (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000
#: Characters that a Python worker works on at a time.
CHARS = 500_000


def batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, the same for all operators; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spans_of(texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about chars characters together; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def portions(batch: pa.RecordBatch, column: int = 1, size: int = CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about size bytes of the column each; a longer value has a slice of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    at = held = 0
    for i, own in enumerate(n):
        if i > at and held + own > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += own
    if at < len(n):
        yield batch.slice(at)


_SCOPES: list[list[Broadcast]] = []


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size; the innermost scoped() destroys it at its end."""
    out = spark.sparkContext.broadcast(value)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scoped() -> Iterator[None]:
    """Around building and writing a frame: what it broadcast goes from driver and executors at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for b in _SCOPES.pop():
            b.destroy()


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch, int], np.ndarray], column: str = "text") -> DataFrame:
    """The rows of docs for which keep(batch, place of column) is true; columns as they were, no exchange.

    Each row is decided by itself, whatever its other columns hold.
    """
    place = [c.lower() for c in docs.columns].index(column)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if len(batch):
                yield batch.filter(pa.array(keep(batch, place), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def remove(folder: str) -> None:
    """Delete a folder of ours; one that is gone already is fine."""
    fs, root = filesystem(folder)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master gets a temporary folder (there is one
    machine); a cluster without the setting is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='folioscan-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name


#: A side of a join is broadcast only if its counted rows stay under this size.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, row_bytes: int = 32) -> tuple[DataFrame, int]:
    """df materialised and its number of rows; hinted for broadcast if it is small.

    A larger one carries no hint and is joined by sort-merge.
    """
    held = cut(df)
    n = held.count()
    return (F.broadcast(held) if n * row_bytes <= BROADCAST_BYTES else held), n


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in the one column of gone; null ids stay."""
    name = fresh(docs, "gone")
    few, _ = sized(gone.toDF(name))
    return docs.join(few, docs["doc_id"] == F.col(name), "left_anti")


# ---------------------------------------------------------------- numpy text


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bmp(test) -> np.ndarray:
    return np.fromiter((test(chr(c)) for c in range(0x10000)), dtype=bool, count=0x10000)


_ALNUM: np.ndarray | None = None


def is_word(codes: np.ndarray) -> np.ndarray:
    """Letters and digits; every code point past the BMP counts as one."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = _bmp(str.isalnum)
    return _ALNUM[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POW, _IPOW = powers(BASE, 1), powers(INV, 1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if n > len(_POW):
        n = max(n, 2 * len(_POW), 1 << 16)
        _POW, _IPOW = powers(BASE, n), powers(INV, n)
    return _POW, _IPOW


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (code+1) * BASE^i over s <= i < e, modulo 2^64."""
    pow_, _ = _grown(len(codes))
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes.astype(U64) + U64(1)) * pow_[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the characters in [start, end), wherever they stand."""
    _, ipow = _grown(len(prefix))
    return mix((prefix[end] - prefix[start]) * ipow[start] + (end - start).astype(U64))


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = is_word(codes)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


#: Characters hashed at a time; a longer text is cut at white space.
SLICE = 2_000_000


def _slices(text: str):
    at = 0
    while len(text) - at > SLICE:
        stop = at + SLICE
        space = text.rfind(" ", at + SLICE // 2, stop)
        stop = space + 1 if space > 0 else stop
        while space <= 0 and stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            stop += 1  # one enormous word stays whole
        yield at, text[at:stop]
        at = stop
    yield at, text[at:]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every lower-cased word of a text of any length.

    Positions are those of the lower-cased text.
    """
    found = []
    for at, part in _slices(text.lower()):
        codes = codepoints(part)
        s, e = word_spans(codes)
        found.append((span_hash(prefix_hash(codes), s, e), s + at, e + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def grouped_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in one array, and the offsets where each begins."""
    hashes, counts = [], []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        low = [t.lower() for t in held]
        codes = codepoints("\n".join(low))
        s, e = word_spans(codes)
        ends = np.cumsum([len(t) + 1 for t in low])
        hashes.append(span_hash(prefix_hash(codes), s, e))
        counts.append(np.diff(np.concatenate(([0], np.searchsorted(s, ends)))))
        held.clear()
        size = 0

    for t in texts:
        if len(t) > SLICE:
            flush()
            h = word_hashes(t)[0]
            hashes.append(h)
            counts.append(np.array([len(h)]))
            continue
        held.append(t)
        size += len(t) + 1
        if size > SLICE:
            flush()
    flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return h, np.concatenate(([0], np.cumsum(c))).astype(np.int64)
