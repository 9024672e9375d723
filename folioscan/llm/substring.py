"""Substring dedup (9): Rabin-Karp hashes of every window of WINDOW tokens.

Every window of every text is hashed with a rolling polynomial over its tokens'
hashes, and all hashes are counted: a shuffle brings equal hashes to one partition,
which counts them. A row of that shuffle holds all hashes that a block of documents
has for one partition (10 bytes a window: the hash and the step from the window
before), so nothing is paid for rows. Before it a block counts for itself: a hash
that repeats within the block is sent once, marked as a repeat, so a passage that
stands in a third of all texts costs a row's place a block, not one a text. The
places of the hashes that occur twice or more go back to their block, a few percent
of the data, where windows that touch or overlap merge into maximal intervals.

The number of partitions follows the bytes of the texts: PARTITION_BYTES of windows
each (and at least one for a core), so a task's memory doesn't grow with the table.

Tokens are the lower-cased runs of letters and digits. Hashes have 64 bits; at n
windows about n^2 / 2^65 pairs are expected to be equal by chance.

Defined results: null and empty texts and texts under WINDOW tokens have no
window; a window repeats whether its copies are in one text or in several, in
rows that repeat an id too; an interval [start_token, end_token) covers every
occurrence, the first one included: rows are told for all. A null doc_id is kept
as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, batches, grouped_words, mix, portions, powers

WINDOW = 50
#: Windows gathered before a block is sent on.
BLOCK = 600_000
DOCS, KNOWN, PLACES, REPEATS = -4, -3, -2, -1
#: Bytes of hashes and steps that a partition counts, about; a byte of text makes some 2.2 of them.
PARTITION_BYTES, PER_BYTE = 24 << 20, 2.2


def window_hashes(words: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of all texts in a row, and how many each text has."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    if not counts.sum():
        return np.zeros(0, U64), counts
    # a rolling hash by doubling: window of 2n from two of n
    start = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pow_ = powers(BASE, size + 1)
    power, h, n, built, done = words, np.zeros(len(words), U64), 1, 0, size
    while done:
        if done & 1:  # append the next n tokens to what is built
            tail = np.zeros(len(words), U64)
            tail[: max(len(words) - built, 0)] = power[built:][: len(words)]
            h = h * pow_[n] + tail
            built += n
        done >>= 1
        if done:
            nxt = power * pow_[n]
            nxt[:-n] += power[n:]
            power, n = nxt, 2 * n
    return mix(h[start]), counts


def _pack(hashes: np.ndarray, at: np.ndarray) -> bytes:
    step = np.diff(at, prepend=0)
    narrow = int(step.max() < 65536)
    return hashes.tobytes() + step.astype(np.uint16 if narrow else np.uint32).tobytes() + bytes([narrow])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    narrow = raw[-1]
    n = (len(raw) - 1) // (10 if narrow else 12)
    return np.frombuffer(raw, U64, n), np.cumsum(np.frombuffer(raw, np.uint16 if narrow else np.uint32, n, 8 * n).astype(np.int64))


def _hash(n_parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            counts = np.concatenate([x[1] for x in held])
            ids = [i for x in held for i in x[2]]
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            again, lead = np.concatenate(([False], same)), np.concatenate((same, [False]))
            known = np.sort(order[again | lead])  # repeated here already
            one, several = np.sort(order[~again & ~lead]), np.sort(order[lead & ~again])
            home = (block >> 32) % n_parts
            has = np.flatnonzero(counts)
            docs = pa.array([ids[i] for i in has], pa.int64())
            docs = np.concatenate((counts[has], docs.is_null().to_numpy(zero_copy_only=False).astype(np.int64), docs.fill_null(0).to_numpy())).astype(np.int64).tobytes()
            part, kinds, data = [home], [DOCS], [docs]
            if len(known):
                part, kinds, data = [*part, home], [*kinds, KNOWN], [*data, known.astype(np.uint32).tobytes()]
            for kind, at in ((PLACES, one), (REPEATS, several)):
                to = ((h[at] >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    own = at[order[edge[p] : edge[p + 1]]]
                    part.append(p)
                    kinds.append(kind)
                    data.append(_pack(h[own], own))
            return pa.record_batch([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "kind", "data"])

        for batch in rows:
            for some in portions(batch):
                h, counts = window_hashes(*grouped_words([t or "" for t in some.column(1).to_pylist()]))
                held.append((h, counts, some.column(0).to_pylist()))
                size += len(h)
                if size >= BLOCK:
                    yield emit()
                    held, size, block = [], 0, block + 1
        if size:
            yield emit()

    return run


SENT = "part int, block long, kind int, data binary"


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition: which hashes occur twice, told as places by block."""
    blocks, hashes, places, again = [], [], [], []
    for batch in rows:
        for block, kind, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind in (DOCS, KNOWN):
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["part", "block", "kind", "data"])
                continue
            h, at = _unpack(data)
            if kind == REPEATS:  # twice, so that it counts as repeated; its own places are known
                again.append(h)
                continue
            blocks.append(block)
            hashes.append(h)
            places.append(at.astype(np.uint32))
    if not hashes:
        return
    size = np.array([len(h) for h in hashes])
    every = np.concatenate([*hashes, *again, *again])
    hashes.clear()
    order = np.argsort(every)
    s = every[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), dtype=bool)
    again[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] = True
    edge = np.cumsum(size) - size
    for block, at, lo, n in zip(blocks, places, edge.tolist(), size.tolist(), strict=True):
        hit = at[again[lo : lo + n]]
        if len(hit):
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([PLACES], pa.int32()), pa.array([hit.astype(np.uint32).tobytes()], pa.binary())], names=["part", "block", "kind", "data"])


SCHEMA = "doc_id long, start_token long, end_token long"


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, kind): a block's documents, then its places, of each of its kinds."""
    block, docs, hits = None, b"", []

    def emit() -> pa.RecordBatch | None:
        if not hits:
            return None
        counts, null, ids = np.frombuffer(docs, np.int64).reshape(3, -1)
        begin = np.cumsum(counts) - counts
        at = np.sort(np.concatenate(hits)).astype(np.int64)
        row = np.searchsorted(begin, at, side="right") - 1
        pos = at - begin[row]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > WINDOW)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return pa.record_batch([pa.array(ids[row[first]], mask=null[row[first]].astype(bool)), pa.array(pos[first]), pa.array(pos[last] + WINDOW)], names=["doc_id", "start_token", "end_token"])

    for batch in rows:
        for b, kind, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if b != block:
                if out := emit():
                    yield out
                block, hits = b, []
            if kind == DOCS:
                docs = data
            else:
                hits.append(np.frombuffer(data, np.uint32))
    if out := emit():
        yield out


def intervals(docs: DataFrame) -> DataFrame:
    """doc_id, start_token, end_token of the maximal intervals of repeated windows."""
    spark = docs.sparkSession
    batches(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, math.ceil(size * PER_BYTE / PARTITION_BYTES))
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_hash(n), SENT)
    told = sent.repartitionById(n, F.col("part")).mapInArrow(_count, SENT)
    return told.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_merge, SCHEMA)
