"""Benchmark decontamination (10): q-gram lemma filtering, then banded alignment.

Text and benchmark items are lower-cased and every run of characters that are no
letter or digit becomes one space. An item of m characters may be found with
k = floor(RATE * m) edits. By the q-gram lemma an occurrence then shares at least
m - q + 1 - q * k q-grams with the item, on diagonals that lie within k of one
another. Per text:
 1. all q-grams are hashed and looked up among the items' q-grams;
 2. stretches with too few hits for any item are passed over (an occurrence holds
    some window of WINDOW positions with its share of the lemma's count);
 3. hits count in diagonal bands of width 2w, w = k + 1, each overlapping the
    next by half, so that the k + 1 diagonals of an occurrence lie within one;
 4. bands that meet the count are aligned with the item, the alignment confined
    to the band and k diagonals to either side; at most k edits are a match.
q is the largest of 8, 4, 2, 1 that leaves the item a positive count.

The index of q-grams is broadcast in slices of at most SLICE_CHARS characters of
items, one pass over the documents for each slice, so its size stays bounded
however large the benchmark is.

Items of under MIN_ITEM normalised characters are found where they stand unchanged
between word borders, by a hash of the characters between each two borders that
lie as far apart.

Defined results: null and empty texts match nothing; null items and items without
a letter or digit are no evidence and are left out; items that repeat an item_id
match apart and the best counts; of equally good places the first is told; an empty
benchmark matches nothing. One row for each pair of a document row and an item_id, with the
least distance and where the match begins and ends in the normalised text. Filtering
(keep_clean) decides every row by its own text, whether its id is null or repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, batches, codepoints, cut, filtered, is_word, mix, portions, prefix_hash, scoped, share, span_hash

RATE, MIN_ITEM, WINDOW, SLICE_CHARS = 0.1, 32, 64, 4_000_000
#: Hits counted at a time (memory only).
HITS = 100_000


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all normalised texts (1 is the space, 0 ends a text), and where each begins."""
    low = [t.lower() for t in texts]
    codes = codepoints("\0".join(low) + "\0")
    word = is_word(codes)
    ends = np.cumsum([len(t) + 1 for t in low]) - 1
    stop = np.zeros(len(codes), dtype=bool)
    stop[ends] = True
    out = np.where(word, codes, np.uint32(1))
    out[stop] = 0
    gap = ~word & ~stop
    # one space for a run, none at a text's ends
    after = np.concatenate(([True], (gap | stop)[:-1]))
    before_end = np.concatenate((stop[1:], [True]))
    keep = ~(gap & (after | before_end))
    trailing = gap & ~after & ~before_end
    # a run that reaches a text's end: its first gap goes too
    if trailing.any():
        run_end = np.flatnonzero(gap & np.concatenate((~gap[1:], [True])))
        at = np.flatnonzero(trailing)
        last = run_end[np.searchsorted(run_end, at)]
        keep[at[stop[np.minimum(last + 1, len(stop) - 1)]]] = False
    out = out[keep]
    stops = np.flatnonzero(out == 0)
    return out, np.concatenate(([0], stops + 1))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position, q a power of two; the last q - 1 are left out."""
    h, n = codes.astype(U64) + U64(1), 1
    base = int(BASE)
    while n < q:
        h = h[:-n] * U64(pow(base, n, 1 << 64)) + h[n:]
        n *= 2
    return h


def plan(m: int, rate: float = RATE) -> tuple[int, int, int]:
    """Edits k, gram size q and the least count of shared grams for an item of m characters."""
    k = int(rate * m)
    for q in (8, 4, 2, 1):
        if (t := m - q + 1 - q * k) >= 1:
            return k, q, t
    raise ValueError("RATE is too high for q-gram filtering")


@dataclass
class Index:
    items: list[np.ndarray] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    k: np.ndarray | None = None
    need: np.ndarray | None = None
    by_q: dict[int, tuple] = field(default_factory=dict)
    #: of short items, by length: sorted hashes and the items that have them
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def index_of(items: list[tuple[int, str]], rate: float = RATE) -> Index:
    out = Index()
    per: dict[int, list[tuple[np.ndarray, int]]] = {}
    ks, need = [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for i, text in items:
        codes = normalised([text or ""])[0][:-1]
        if not len(codes):
            continue
        if len(codes) < MIN_ITEM:
            h = span_hash(prefix_hash(codes), np.array([0]), np.array([len(codes)]))[0]
            short.setdefault(len(codes), []).append((int(h), len(out.items)))
            out.items.append(codes)
            out.ids.append(i)
            ks.append(0)
            need.append(1)
            continue
        k, q, t = plan(len(codes), rate)
        per.setdefault(q, []).append((grams(codes, q), len(out.items)))
        out.items.append(codes)
        out.ids.append(i)
        ks.append(k)
        need.append(t)
    out.k, out.need = np.array(ks, dtype=np.int64), np.array(need, dtype=np.int64)
    for m, own in short.items():
        own.sort()
        out.short[m] = (np.array([h for h, _ in own], dtype=U64), np.array([j for _, j in own], dtype=np.int64))
    for q, own in per.items():
        h = np.concatenate([g for g, _ in own])
        item = np.concatenate([np.full(len(g), j) for g, j in own])
        pos = np.concatenate([np.arange(len(g)) for g, _ in own])
        order = np.argsort(h, kind="stable")
        key, first = np.unique(h[order], return_index=True)
        bits = 1 << 22
        maybe = np.zeros(bits, dtype=bool)
        maybe[mix(key) >> U64(64 - 22)] = True
        # the least hits that some window of WINDOW positions holds, over all items of this q
        least = min(-(-int(out.need[j]) // -(-(len(out.items[j]) + int(out.k[j]) - q + 1) // WINDOW)) for _, j in own)
        out.by_q[q] = (key, np.append(first, len(h)), item[order], pos[order], maybe, least)
    return out


def banded(item: np.ndarray, codes: np.ndarray, lo: np.ndarray, t0: np.ndarray, t1: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of item against a part of the text codes[t0:t1] whose diagonals (place in codes
    - item place) lie in lo .. lo + width - 1, for all candidates at once; with the beginnings and
    ends of the parts.
    """
    n, m = len(lo), len(item)
    big = 1 << 20
    step = np.arange(width, dtype=np.int64)[None, :]
    start = lo[:, None] + step
    t0, t1, rows = t0[:, None], t1[:, None], np.arange(n)[:, None]
    # with nothing of the item read, every place of the text is free, its end too
    cost = np.where((start < t0) | (start > t1), big, 0)
    begin = start.copy()
    for i in range(m):
        at = start + i  # the place that a diagonal reads for item place i
        same = codes[np.minimum(np.maximum(at, 0), len(codes) - 1)] == item[i]
        # a match or a change stays on the diagonal; leaving out item[i] comes from the one above
        new = np.where((at >= t0) & (at < t1), cost + ~same, big)
        drop = cost[:, 1:] + 1
        less = drop < new[:, :-1]
        new[:, :-1][less] = drop[less]
        first = begin.copy()
        first[:, :-1][less] = begin[:, 1:][less]
        # reading a character more goes up a diagonal: a running minimum, its last place the source
        slack = new - step
        low = np.minimum.accumulate(slack, axis=1)
        came = np.maximum.accumulate(np.where(slack == low, step, 0), axis=1)
        cost = np.minimum(low + step, big)
        cost[(at + 1 < t0) | (at + 1 > t1)] = big
        begin = first[rows, came]
    best = np.argmin(cost, axis=1)
    r = np.arange(n)
    return cost[r, best], begin[r, best], start[r, best] + m


def exact(item: np.ndarray, codes: np.ndarray, lo: np.ndarray, t0: np.ndarray, t1: np.ndarray, width: int) -> np.ndarray:
    """The first diagonal of each candidate's on which the item stands unchanged, or -1."""
    at = lo[:, None] + np.arange(width)[None, :]
    fit = (at >= t0[:, None]) & (at + len(item) <= t1[:, None])
    c, d = np.nonzero(fit)
    for i in range(len(item)):
        if not len(c):
            break
        same = codes[lo[c] + d + i] == item[i]
        c, d = c[same], d[same]
    out = np.full(len(lo), -1, dtype=np.int64)
    out[c[::-1]] = (lo[c] + d)[::-1]
    return out


def _short(index: Index, codes: np.ndarray, begin: np.ndarray, found: dict) -> None:
    """The first place of each short item in each text, between word borders."""
    if not index.short or not len(codes):
        return
    border = codes <= 1
    starts = np.flatnonzero(~border & np.concatenate(([True], border[:-1])))
    prefix = prefix_hash(codes)
    for m, (key, item) in index.short.items():
        at = starts[starts + m < len(codes)]
        at = at[border[at + m]]
        h = span_hash(prefix, at, at + m)
        lo, hi = np.searchsorted(key, h, side="left"), np.searchsorted(key, h, side="right")
        for x, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            row = int(np.searchsorted(begin, x, side="right")) - 1
            for j in item[a:b].tolist():
                if (row, j) not in found and np.array_equal(codes[x : x + m], index.items[j]):
                    place = x - int(begin[row])
                    found[row, j] = (0, place, place + m)


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, begin, end) for all matches, the best of each row and item."""
    codes, begin = normalised(texts)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    _short(index, codes, begin, found)
    for q, (key, first, item, pos, maybe, least) in index.by_q.items():
        if len(codes) < q:
            continue
        h = grams(codes, q)
        hit = maybe[mix(h) >> U64(64 - 22)]
        upto = np.concatenate(([0], np.cumsum(hit)))
        w = min(WINDOW, len(h))
        dense = np.flatnonzero(upto[w:] - upto[:-w] >= least)
        if not len(dense):
            continue
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + w, -1)
        # an occurrence has other windows under the mean beside its dense one: take in its whole reach
        reach = int(max(len(index.items[j]) + index.k[j] for j in set(item.tolist()))) + w
        lo, hi = np.maximum(dense - reach, 0), np.minimum(dense + w + reach, len(h))
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & hit)
        place = np.searchsorted(key, h[at])
        place[place == len(key)] = 0
        good = key[place] == h[at]
        at, place = at[good], place[good]
        # whole texts at a time, so that no band is split
        row = np.searchsorted(begin, at, side="right") - 1
        edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(at)).tolist()
        done = 0
        for a, b in zip(edge, edge[1:], strict=False):
            if b - done > HITS or b == len(at):
                _count(index, codes, begin, item, pos, first, at[done:b], place[done:b], found)
                done = b
    return [(row, j, *v) for (row, j), v in sorted(found.items())]


def _count(index: Index, codes: np.ndarray, begin: np.ndarray, item: np.ndarray, pos: np.ndarray, first: np.ndarray, at: np.ndarray, place: np.ndarray, found: dict) -> None:
    n = first[place + 1] - first[place]
    total = np.cumsum(n)
    if not len(total):
        return
    src = np.repeat(first[place] - (total - n), n) + np.arange(total[-1])
    j, diag = item[src], np.repeat(at, n) - pos[src]
    w = index.k[j] + 1
    # diagonals count from far below zero, so that all are positive
    far = 1 << 24
    band = (diag + far) // w
    span = (1 << 34) - 1
    name = np.concatenate((j << 34 | (band & span), j << 34 | ((band - 1) & span)))
    names, size = np.unique(name, return_counts=True)
    own = names >> 34
    names = names[size >= index.need[own]]
    for j, bands in ((j, names[names >> 34 == j] & span) for j in np.unique(names >> 34).tolist()):
        k = int(index.k[j])
        low = bands * (k + 1) - far  # diagonals low .. low + 2w - 1
        # the text that a band lies in: that of the middle of its occurrence, or one beside it
        m = len(index.items[j])
        row = np.searchsorted(begin, np.clip(low + k + 1 + m // 2, 0, len(codes) - 1), side="right") - 1
        row = np.concatenate((row, row - 1, row + 1))
        lo, width = np.tile(low - k, 3), 4 * k + 2
        fits = (row >= 0) & (row < len(begin) - 1)
        row, lo = row[fits], lo[fits]
        t0, t1 = begin[row], begin[row + 1] - 1
        fits = (lo + width > t0 - m) & (lo < t1) & (t1 - t0 + k >= m)
        row, lo, t0, t1 = row[fits], lo[fits], t0[fits], t1[fits]
        if not len(row):
            continue
        place = exact(index.items[j], codes, lo, t0, t1, width)
        for r, x in zip(row[place >= 0].tolist(), (place - t0)[place >= 0].tolist(), strict=True):
            found[r, j] = min(found.get((r, j), (1 << 30, 0, 0)), (0, x, x + m))
        rest = ~np.isin(row, row[place >= 0])
        if rest.any():
            t0 = t0[rest]
            cost, b, e = banded(index.items[j], codes, lo[rest], t0, t1[rest], width)
            for r, c, x, y in zip(row[rest].tolist(), cost.tolist(), (b - t0).tolist(), (e - t0).tolist(), strict=True):
                if c <= k:
                    found[r, j] = min(found.get((r, j), (1 << 30, 0, 0)), (c, x, y))


SCHEMA = "doc_id long, item_id long, distance int, start long, stop long"


def _slices(bench: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in bench.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        if size and size + len(row[1]) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    yield held


def matches(docs: DataFrame, bench: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, stop."""
    spark = docs.sparkSession
    batches(spark)
    out = None
    for held in _slices(bench):
        shared = share(spark, index_of(held, rate))

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in rows:
                for part in portions(batch):
                    ids = part.column(0).to_pylist()
                    best: dict[tuple, tuple] = {}
                    for r, j, c, b, e in search(index, [t or "" for t in part.column(1).to_pylist()]):
                        key = (r, index.ids[j])
                        best[key] = min(best.get(key, (1 << 30, 0, 0)), (c, b, e))
                    if best:
                        yield pa.record_batch([pa.array([ids[r] for r, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), *(pa.array([v[n] for v in best.values()], t) for n, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "distance", "start", "stop"])

        own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
        out = own if out is None else out.unionByName(own)
    return out


def keep_clean(docs: DataFrame, bench: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows in which an item was found, each decided by its own text; columns as they were.

    A benchmark of several slices goes through one after the other, each on what the
    slice before it kept, written in between.
    """
    spark = docs.sparkSession
    batches(spark)
    before = None
    for held in _slices(bench):
        if before is not None:
            with scoped():
                docs = cut(_without(docs, before))
        before = index_of(held, rate)
    return _without(docs, before)


def _without(docs: DataFrame, index: Index) -> DataFrame:
    shared = share(docs.sparkSession, index)

    def keep(batch: pa.RecordBatch, place: int) -> np.ndarray:
        out, at = np.ones(len(batch), dtype=bool), 0
        for part in portions(batch, place):
            found = search(shared.value, [t or "" for t in part.column(place).to_pylist()])
            out[[at + r for r, *_ in found]] = False
            at += len(part)
        return out

    return filtered(docs, keep)
