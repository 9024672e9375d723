"""Sharding (4): histogram sort into shards of equal bytes, in key order.

Only (key, bytes) rows are kept for the histograms. In each round candidate
boundaries (probes) are broadcast, PROBES for each splitter that is still open,
and every partition counts the exact bytes of the keys below each; the sums
narrow each splitter's bracket until its boundary has the wanted bytes below it,
give or take TOLERANCE of a shard, or until the bracket holds one key alone,
which can't be split. Then the documents are exchanged once, by their shard's
number, and sorted within it.

The number of shards is that of SHARD_BYTES in the table, so a shard's size doesn't
grow with the table. A round has PROBES probes for an open splitter, fewer (one at
least) where that makes over MOST_PROBES: what is broadcast and what comes back stay
within some MB at millions of shards.

Defined results: null keys come first, as if they were the lowest key; rows with
equal keys stay in one shard, however large; null and empty texts weigh nothing;
a table without bytes, or with no row, goes to shard 0. Keys are integers, dates or
timestamps (told apart by the microsecond); a key of another type is refused with a
ValueError. The number of the shard is shard_id, or _shard_id where docs has that column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import cut, fresh, share

SHARD_BYTES, TOLERANCE, PROBES, MOST_PROBES = 64 << 20, 0.01, 8, 1_000_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _below(slim: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the keys under each probe."""
    shared = share(slim.sparkSession, probes)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        total = np.zeros(len(p) + 1, dtype=np.int64)
        for batch in rows:
            at = np.searchsorted(p, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, at, batch.column(1).to_numpy(zero_copy_only=False))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["place", "bytes"])

    out = np.zeros(len(probes) + 1, dtype=np.int64)
    for place, size in slim.mapInArrow(count, "place long, bytes long").groupBy("place").agg(F.sum("bytes")).collect():
        out[place] = size
    return np.cumsum(out)[:-1]


def splitters(slim: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Boundaries for rows of key and bytes: shard i holds the keys from boundary i - 1 up to boundary i.

    A boundary past the highest 64-bit key, under which everything lies, is left out: no key reaches it.
    """
    low, high, total = slim.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if not total or shards < 2:
        return []
    # keys as distances from the lowest one, which 64 bits without a sign hold
    want = np.arange(1, shards) * (total / shards)
    near, span = tolerance * total / shards, int(high) - int(low)
    # bracket: a distance under which at most the wanted bytes lie, and one under which at least those do
    lo, hi = np.zeros(len(want), dtype=np.uint64), np.full(len(want), span, dtype=np.uint64)
    lo_bytes, hi_bytes = np.zeros(len(want)), np.full(len(want), float(total))
    beyond = np.ones(len(want), dtype=bool)  # hi stands for span + 1 yet
    while True:
        wide = hi - lo + beyond.astype(np.uint64)  # 0 stands for 2^64
        one = (wide == 1) & ~((hi - lo == np.uint64((1 << 64) - 1)) & beyond)
        open_ = (np.minimum(np.abs(lo_bytes - want), np.abs(hi_bytes - want)) > near) & ~one
        if not open_.any():
            break
        i = np.flatnonzero(open_)
        each = int(max(1, min(PROBES, MOST_PROBES // len(i))))
        gap = (hi - lo)[i]
        share_of = (want[i] - lo_bytes[i]) / np.maximum(hi_bytes[i] - lo_bytes[i], 1)
        steps = [gap // np.uint64(each + 1) * np.uint64(n) + gap % np.uint64(each + 1) * np.uint64(n) // np.uint64(each + 1) for n in range(1, each + 1)]
        guess = np.minimum((gap.astype(np.float64) * share_of), gap.astype(np.float64) * (1 - 2**-50)).astype(np.uint64)
        edge = gap if beyond[i].all() else np.where(beyond[i], gap, gap - np.uint64(1))
        tried = np.unique(np.concatenate([lo[i] + np.clip(x, np.uint64(1), np.maximum(edge, np.uint64(1))) for x in (*steps, guess)]))
        at = (tried + np.uint64(int(low) % (1 << 64))).view(np.int64)
        below = _below(slim, at).astype(np.float64)
        j = np.searchsorted(below, want[i], side="right")
        up = np.flatnonzero((j > 0) & (tried[np.maximum(j - 1, 0)] > lo[i]))
        lo[i[up]], lo_bytes[i[up]] = tried[j[up] - 1], below[j[up] - 1]
        inside = np.minimum(j, len(tried) - 1)
        down = np.flatnonzero((j < len(tried)) & ((tried[inside] < hi[i]) | (tried[inside] == hi[i]) & beyond[i]))
        hi[i[down]], hi_bytes[i[down]], beyond[i[down]] = tried[j[down]], below[j[down]], False
    first = np.abs(lo_bytes - want) <= np.abs(hi_bytes - want)
    out = [int(low) + (int(a) if f else int(b) + int(x)) for a, b, x, f in zip(lo, hi, beyond, first, strict=True)]
    return [b for b in sorted(out) if b <= HIGHEST]


def _key(docs: DataFrame, key: str):
    kind = docs.schema[key].dataType.typeName()
    if kind == "date":
        return F.unix_date(key).cast("long")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(key).cast("timestamp"))
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"a key of type {kind} isn't an integer, a date or a timestamp")
    return F.col(key).cast("long")


def shard(docs: DataFrame, key: str = "doc_id", shards: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs and shard_id, exchanged into shards of nearly equal bytes in key order: `shards` of them, or one for every SHARD_BYTES."""
    own = F.coalesce(_key(docs, key), F.lit(LOWEST))
    slim = cut(docs.select(own.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    if shards is None:
        shards = max(1, -(-(slim.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    at = np.array(splitters(slim, shards, tolerance), dtype=np.int64)

    @pandas_udf("int")
    def place(k):
        import pandas as pd

        return pd.Series(np.searchsorted(at, k.to_numpy(), side="right").astype(np.int32))

    name = "shard_id" if "shard_id" not in {c.lower() for c in docs.columns} else fresh(docs, "shard_id")
    return docs.withColumn(name, place(own)).repartitionById(shards, F.col(name)).sortWithinPartitions(F.col(key).asc_nulls_first())
