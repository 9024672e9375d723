"""MinHash near-dedup (5): a multi-index Hamming join of b-bit signatures.

A signature is K b-bit components (b = 16), each 16 mixed bits of a MinHash over
the text's shingles of SHINGLE words; the distance of two signatures is the
number of components in which they differ. For all pairs within RADIUS the
signature is split into CHUNKS chunks: by the pigeonhole principle one chunk
differs in at most RADIUS // CHUNKS = ERRORS components. Each allowed set of
errors is enumerated by leaving those components out, so two signatures within
RADIUS share at least one (chunk, left-out set, remaining components) key.

What happens with the keys:
 1. texts with equal signatures become one row, the others hang on it;
 2. a key that a sixteenth of the signatures, taken by hash, shows to have about HOT
    members or more isn't shuffled: its members are split by further keys. A pair
    within RADIUS that shares chunk c has at most RADIUS errors in the other chunks,
    so one of these differs in at most RADIUS // (CHUNKS - 1) components, and the
    members get a key for each of them and each allowed set of errors. What is still
    hot after that is cut into blocks, and every two blocks are compared. Which keys
    are split bears on the work alone, never on the result;
 3. all other keys (16 bytes a row) are shuffled once; a key that one signature holds
    is dropped on the spot, and so are further keys with the same members;
 4. each bucket of signatures is searched exhaustively, but by a frontier: a member
    that was reached isn't compared again, so a bucket of n copies costs about n
    comparisons. A bucket yields a spanning forest of its pairs within RADIUS, so no
    pair's connection is lost and no quadratic set of pairs is ever written;
 5. connected components over the forest edges give the groups.

Defined results: null and empty texts and texts without a word have no
signature; each is its own group. A text of fewer than SHINGLE words is one
shingle. Rows are grouped by their text, whether their doc_id is null or repeats;
group_id is the lowest doc_id of a group, null where all are. A filter keeps the row
with the lowest doc_id of each group (null ids come last; of rows that repeat an id
and a signature the first by their columns' values) and all rows without a signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import U64, batches, cut, fresh, grouped_words, mix, parts, portions, sized, without

K, SHINGLE, RADIUS, CHUNKS, BYTES = 64, 3, 32, 11, 2
ERRORS, MORE_ERRORS = RADIUS // CHUNKS, RADIUS // (CHUNKS - 1)
#: Members from which on a bucket is split, and the share of signatures that tells (1 / SAMPLED).
HOT, SAMPLED = 1 << 16, 16
#: Names that a task remembers so as not to tell them twice (speed only).
TOLD = 1_000_000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, K, dtype=np.uint64) | U64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)


def chunk_bounds(k: int = K, chunks: int = CHUNKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, k, chunks + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def shingles(words: np.ndarray) -> np.ndarray:
    if len(words) <= SHINGLE:
        return mix(np.add.reduce(words * np.arange(1, 2 * len(words), 2, dtype=U64), keepdims=True)) if len(words) else words
    h = words[: len(words) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        h = h * U64(0x9DDFEA08EB382D69) + words[i : len(words) - SHINGLE + 1 + i]
    return mix(h)


def signature(sh: np.ndarray) -> bytes:
    """K components of BYTES bytes. Long texts go through in pieces, so memory stays bounded."""
    low = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    x = (sh >> U64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        h = part[None, :] * _A[:, None] + _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (low >> np.uint32(16)).astype(">u2").tobytes()


def signatures_of(texts: list[str]) -> list[bytes | None]:
    h, off = grouped_words(texts)
    out: list[bytes | None] = []
    for i in range(len(texts)):
        own = h[off[i] : off[i + 1]]
        out.append(signature(shingles(own)) if len(own) else None)
    return out


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in rows for p in portions(batch)):
        sig = signatures_of([t or "" for t in part.column(1).to_pylist()])
        yield pa.record_batch([part.column(0), pa.array(sig, pa.binary())], names=["id", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, "id long, sig binary")


def _left_out(lo: int, hi: int, errors: int) -> Iterator[list]:
    """Of each way to leave out components of a chunk, the expressions of what is left."""
    for gone in combinations(range(lo, hi), errors):
        kept, run = [], lo
        for g in [*gone, hi]:
            if g > run:
                kept.append(F.substring("sig", BYTES * run + 1, BYTES * (g - run)))
            run = g + 1
        yield kept


def keys_of():
    """Array of 64-bit keys, one for each chunk and each allowed set of errors; the last four bits name the chunk."""
    out = []
    for c, (lo, hi) in enumerate(chunk_bounds()):
        for m, kept in enumerate(_left_out(lo, hi, ERRORS)):
            out.append(F.shiftleft(F.xxhash64(F.lit(c * 1000 + m), *kept), 4).bitwiseOR(F.lit(c)))
    return F.array(*out)


def more_keys_of():
    """Array of further keys of a member of bucket: of all chunks but the bucket's own."""
    out = []
    for c, (lo, hi) in enumerate(chunk_bounds()):
        own = [F.xxhash64(F.col("bucket"), F.lit(c * 1000 + m), *kept) for m, kept in enumerate(_left_out(lo, hi, MORE_ERRORS))]
        out.append(F.when(F.col("bucket").bitwiseAND(F.lit(15)) != c, F.array(*own)).otherwise(F.array().cast("array<bigint>")))
    return F.flatten(F.array(*out))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    return edge[:-1], edge[1:]


def _buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows to (bucket, id) rows of the keys that several ids share."""
    told: set[int] = set()
    held_k, held_i = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def emit(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch | None:
        start, end = _runs(k)
        many = end - start > 1
        start, end = start[many], end[many]
        if not len(start):
            return None
        weight = mix(i.view(U64))
        total = np.concatenate(([U64(0)], np.cumsum(weight)))
        name = mix((total[end] - total[start]) + (end - start).astype(U64)).view(np.int64)
        new = []
        for j, n in enumerate(name.tolist()):
            if n not in told:
                if len(told) >= TOLD:
                    told.clear()
                told.add(n)
                new.append(j)
        if not new:
            return None
        start, end, name = start[new], end[new], name[new]
        size = end - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return pa.record_batch([pa.array(np.repeat(name, size)), pa.array(i[at])], names=["bucket", "id"])

    for batch in rows:
        k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        i = np.concatenate((held_i, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(k):
            continue
        last = np.searchsorted(k, k[-1], side="left")  # the last key may go on in the next batch
        if last and (out := emit(k[:last], i[:last])):
            yield out
        held_k, held_i = k[last:], i[last:]
    if len(held_k) and (out := emit(held_k, held_i)):
        yield out


def forest(sigs: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of all pairs within radius."""
    left = np.arange(1, len(sigs))
    edges, queue = [], [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = np.zeros(len(left), dtype=bool)
        for lo in range(0, len(left), 65536):
            near[lo : lo + 65536] = (sigs[left[lo : lo + 65536]] != sigs[at]).sum(axis=1) <= radius
        reached = left[near]
        edges += [(at, int(r)) for r in reached]
        queue += reached.tolist()
        left = left[~near]
    return edges


def _edges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, id, sig) rows to edges (a, b), a < b."""
    told: set[tuple[int, int]] = set()
    bucket, ids, sigs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, K), np.uint16)

    def emit(upto: int) -> pa.RecordBatch | None:
        out: list[tuple[int, int]] = []
        for lo, hi in zip(*_runs(bucket[:upto]), strict=True):
            if hi - lo > 1:
                a, b = ids[lo:hi], sigs[lo:hi]
                for x, y in forest(b):
                    e = (int(min(a[x], a[y])), int(max(a[x], a[y])))
                    if e not in told:
                        if len(told) >= TOLD:
                            told.clear()
                        told.add(e)
                        out.append(e)
        return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]) if out else None

    for batch in rows:
        if not len(batch):
            continue
        bucket = np.concatenate((bucket, batch.column(0).to_numpy(zero_copy_only=False)))
        ids = np.concatenate((ids, batch.column(1).to_numpy(zero_copy_only=False)))
        sigs = np.concatenate((sigs, np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, K)))
        last = int(np.searchsorted(bucket, bucket[-1], side="left"))  # the last bucket may go on in the next batch
        if last:
            if out := emit(last):
                yield out
            bucket, ids, sigs = bucket[last:], ids[last:], sigs[last:]
    if len(bucket) and (out := emit(len(bucket))):
        yield out


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows (key, id) to (bucket, id) of the keys that several ids share."""
    n = parts(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(_buckets, "bucket long, id long")


def _hot(keyed: DataFrame) -> DataFrame:
    """hot and n: keys of about HOT members or more, told by the rows (key) of a share of the signatures."""
    return cut(keyed.groupBy(F.col("key").alias("hot")).agg((F.count(F.lit(1)) * SAMPLED).alias("n")).where(F.col("n") >= HOT // 2))


def members(sigs: DataFrame) -> DataFrame:
    """bucket and id: every two signatures within RADIUS are together in some bucket."""
    some = sigs.where(F.pmod(F.xxhash64("sig"), F.lit(SAMPLED)) == 0)
    keyed = lambda df: df.select(F.explode(keys_of()).alias("key"), "id")
    hot = _hot(keyed(some))
    if hot.isEmpty():
        return _shared(keyed(sigs))
    few, _ = sized(hot)
    out = _shared(keyed(sigs).join(few, F.col("key") == F.col("hot"), "left_anti"))
    # members of hot keys by further keys; the signatures are joined to them by id
    split = lambda df: keyed(df).join(few, F.col("key") == F.col("hot"), "left_semi").select(F.col("key").alias("bucket"), F.col("id").alias("i")).join(df, F.col("i") == F.col("id")).select(F.explode(more_keys_of()).alias("key"), "id")
    still = _hot(split(some))
    if still.isEmpty():
        return out.unionByName(_shared(split(sigs)))
    few_still, _ = sized(still)
    out = out.unionByName(_shared(split(sigs).join(few_still.select("hot"), F.col("key") == F.col("hot"), "left_anti")))
    # blocks of about HOT / 2 members; a member goes where its block meets each of the blocks
    blocks = F.greatest(F.ceil(F.col("n") * 2 / HOT), F.lit(1)).cast("int")
    own = split(sigs).join(few_still.select("hot", blocks.alias("blocks")), F.col("key") == F.col("hot")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return out.unionByName(met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "id"))


def edges(sigs: DataFrame) -> DataFrame:
    """sigs: id, sig (one id to a signature). Edges that connect all pairs within RADIUS."""
    n = parts(sigs.sparkSession)
    held = members(sigs).distinct().join(sigs.select(F.col("id").alias("i"), "sig"), F.col("id") == F.col("i")).select("bucket", "id", "sig")
    return held.repartition(n, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(_edges, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """id, root: the lowest id of the connected component, for each id of an edge (a, b).

    Large-star and small-star steps in turn: every step keeps the components and
    the number of steps grows with the logarithm of their diameter.
    """
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select("b", "a")) if large else links
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
        # large: neighbours above the node go to its lowest neighbour; small: the rest, and the node itself.
        hung = both.join(low, F.col("a") == F.col("n"))
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def mark(links: DataFrame):
        return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        now = cut(star(star(now, True), False))
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _rooted(signed: DataFrame) -> DataFrame:
    """signed (id, sig) with root, equal for all rows of a group; null where a text has no signature."""
    one = cut(signed.where("sig is not null").select("sig").distinct().select(F.monotonically_increasing_id().alias("id"), "sig"))
    roots = components(edges(one))
    named = one.join(roots.select(F.col("id").alias("i"), "root"), F.col("id") == F.col("i"), "left").select(F.col("sig").alias("s"), F.coalesce("root", "id").alias("root"))
    return signed.join(named, F.col("sig") == F.col("s"), "left").select("id", "sig", "root")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, a row for each row of docs."""
    told = cut(_rooted(cut(signatures(docs))))
    lowest = told.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return told.join(lowest, F.col("root") == F.col("r"), "left").select(F.col("id").alias("doc_id"), F.coalesce("low", "id").alias("group_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group; columns as they were."""
    told = cut(_rooted(cut(signatures(docs))))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "sig")
    first = told.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = told.join(first, F.col("root") == F.col("r")).where(~(order == F.col("f")))
    # ids that a row shares with no other decide by themselves
    twice = cut(told.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select("id"))
    if twice.isEmpty():
        return without(docs, gone.select("id"))
    few, _ = sized(twice.where("id is not null"))
    kept = without(docs.where(docs["doc_id"].isNotNull()), gone.where("id is not null").select("id").unionByName(few).distinct())
    # the others by id and signature; of rows equal in both one stays
    name, sig, nth = fresh(docs, "twice"), fresh(docs, "sig"), fresh(docs, "nth")
    odd = docs.join(few.toDF(name), docs["doc_id"] == F.col(name), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    place = [c.lower() for c in docs.columns].index("text")

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in rows for p in portions(batch, place)):
            yield pa.record_batch([*part.columns, pa.array(signatures_of([t or "" for t in part.column(place).to_pylist()]), pa.binary())], names=[*part.schema.names, sig])

    odd = odd.mapInArrow(sign, StructType([*docs.schema.fields, StructField(sig, BinaryType())]))
    row, left = Window.partitionBy("doc_id", sig).orderBy(*[F.col(c).cast("string") for c in docs.columns]), gone.select(F.col("id").alias(name), F.col("sig").alias(nth)).distinct()
    odd = odd.join(left, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(sig) == F.col(nth)), "left_anti")
    odd = odd.withColumn(nth, F.row_number().over(row)).where((F.col(nth) == 1) | F.col(sig).isNull())
    return kept.select(*docs.columns).unionByName(odd.select(*docs.columns))
