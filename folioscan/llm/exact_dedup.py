"""Exact dedup (1): a cuckoo filter proposes, the bucketed content decides.

Slim rows (a 64-bit digest of the text) are shuffled by digest. Each partition
keeps a cuckoo filter over the digests that it has seen; a digest that hits is a
candidate. Only documents with a candidate digest have their text compared, by a
grouping on (digest, text) that is combined before its shuffle, so a group of
thousands of copies costs one row a partition. A false hit or a digest collision
thus can't merge two different texts.

TextIndex keeps texts over many tables: insertions and deletions are written as
Parquet, bucketed by digest, and a look-up replays a bucket's digests into a filter,
deletions too, before it compares content.

Defined results: a null text has no digest and is never a copy; empty texts are
copies of one another; among copies the lowest doc_id stays (null ids come
last); in a filter (keep_first) rows that repeat an id and a text count as
copies and one stays; other columns are carried along and never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, fresh, mix, parts, remove, shared_dir, sized

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """16-bit fingerprints in buckets of four, with the live keys beside them as a sorted array.

    The keys serve to verify deletions and to rebuild a filter of twice the size
    when an insertion overflows. A key that is inserted twice needs two deletions.
    Both work on whole batches of keys.
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.keys, self.count = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self._make(max(16, 1 << int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85)))))

    def _make(self, buckets: int) -> None:
        self.n = buckets
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.resizes = getattr(self, "resizes", -1) + 1

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(U64))
        prints = (h >> U64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & U64(self.n - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(U64)) & U64(self.n - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """May hold false positives, never false negatives."""
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def _held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys stand or would stand among the live ones, and whether they do."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def insert(self, keys: np.ndarray) -> None:
        one, n = np.unique(keys.astype(U64), return_counts=True)
        at, there = self._held(one)
        self.count[at[there]] += n[there]
        new = one[~there]
        self.keys, self.count = np.insert(self.keys, at[~there], new), np.insert(self.count, at[~there], n[~there])
        left = self._fill(new)
        while left:
            self._make(2 * self.n)
            left = self._fill(self.keys)

    def _fill(self, keys: np.ndarray) -> bool:
        """Place all keys; True if one found no place (the table is then to be rebuilt)."""
        if not len(keys):
            return False
        if len(self.keys) > 0.95 * self.n * SLOTS:
            return True
        prints, a, b = self._places(keys)
        left = np.arange(len(keys))
        for at in (a, b):
            for slot in range(SLOTS):
                free = left[self.table[at[left], slot] == 0]
                _, one = np.unique(at[free], return_index=True)
                took = free[one]
                self.table[at[took], slot] = prints[took]
                left = np.setdiff1d(left, took, assume_unique=True)
        return any(not self._kick(int(a[i]), int(prints[i])) for i in left)

    def _kick(self, bucket: int, print_: int) -> bool:
        for turn in range(MAX_KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
            slot = (turn * 7 + print_) % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], dtype=np.uint16))[0])
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Remove live keys; False where a key isn't live (any more), nothing is then touched."""
        keys = keys.astype(U64)
        one, first, back, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at, there = self._held(one)
        live = np.zeros(len(one), dtype=np.int64)
        live[there] = self.count[at[there]]
        # the nth mention of a key within the batch goes through while a live one is left
        order = np.argsort(back, kind="stable")
        nth = np.empty(len(keys), dtype=np.int64)
        nth[order] = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        out = nth < live[back]
        self.count[at[there]] -= np.minimum(n, live)[there]
        gone = one[there & (n >= live)]
        self.keys, self.count = self.keys[self.count > 0], self.count[self.count > 0]
        prints, a, b = self._places(gone)
        left = np.arange(len(gone))
        for place in (a, b):
            for slot in range(SLOTS):
                match = left[self.table[place[left], slot] == prints[left]]
                _, took = np.unique(place[match], return_index=True)
                took = match[took]
                self.table[place[took], slot] = 0
                left = np.setdiff1d(left, took, assume_unique=True)
        return out


def _hits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, told = CuckooFilter(1 << 14), np.zeros(0, dtype=U64)
    for batch in rows:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
        one, n = np.unique(keys, return_counts=True)
        known = index.contains(one)
        index.insert(one[~known])
        hit = np.setdiff1d(one[known | (n > 1)], told, assume_unique=True)
        told = np.union1d(told, hit)
        if len(hit):
            yield pa.record_batch([pa.array(hit.view(np.int64))], names=["hit"])


def hit_digests(docs: DataFrame) -> DataFrame:
    """Digests (hit) that the filters saw more than once; a few may be false hits."""
    slim = docs.select(F.xxhash64("text").alias("h")).where(docs["text"].isNotNull())
    return slim.repartition(parts(docs.sparkSession), "h").mapInArrow(_hits, "hit long")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (the lowest id of its text) and n_copies, a row for each row of docs."""
    own = docs.select("doc_id", "text", F.when(docs["text"].isNotNull(), F.xxhash64("text")).alias("h"))
    hits, _ = sized(hit_digests(docs))
    same = own.join(hits, F.col("h") == F.col("hit"), "left_semi").groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    # One text to a digest, as good as always: the digest then stands for the text.
    whole, _ = sized(same.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("k"), F.max("n_copies").alias("n")).withColumnRenamed("h", "g"), 64)
    sure = own.select("doc_id", "h").join(whole, F.col("h") == F.col("g"), "left")
    plain = sure.where("texts is null or texts = 1").select("doc_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("k")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n_copies"))
    clash = whole.where("texts > 1").select("g")
    if clash.isEmpty():
        return plain
    by_text = same.join(clash, F.col("h") == F.col("g"), "left_semi").select(F.col("h").alias("g"), F.col("text").alias("t"), "keep_id", "n_copies")
    told = own.join(by_text, (F.col("h") == F.col("g")) & (F.col("text") == F.col("t"))).select("doc_id", "keep_id", "n_copies")
    return plain.unionByName(told)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row for each text, columns as they were."""
    h, hit, nth = fresh(docs, "h"), fresh(docs, "hit"), fresh(docs, "nth")
    hits, _ = sized(hit_digests(docs).toDF(hit))
    own = docs.withColumn(h, F.when(docs["text"].isNotNull(), F.xxhash64("text")))
    single = own.join(hits, F.col(h) == F.col(hit), "left_anti")
    order = Window.partitionBy(h, "text").orderBy(F.col("doc_id").asc_nulls_last(), *[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")])
    first = own.join(hits, F.col(h) == F.col(hit), "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return single.select(*docs.columns).unionByName(first.select(*docs.columns))


BUCKETS = 64


class TextIndex:
    """The live texts of many tables, in the shared folder: insert, delete, and tell which texts of a table are live.

    A text inserted n times stays live until it is deleted n times; to delete one that
    isn't live does nothing. Null texts are passed over. Content lies in BUCKETS
    folders by digest.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.steps = spark, 0
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, sign: int) -> None:
        """rows: text and n."""
        self.steps += 1
        h = F.xxhash64("text")
        rows.select(h.alias("h"), "text", F.lit(self.steps).alias("step"), (F.col("n") * sign).alias("n"), F.pmod(h, F.lit(BUCKETS)).alias("bucket")).write.partitionBy("bucket").mode("append").parquet(self.folder)

    def insert(self, docs: DataFrame) -> None:
        self._write(_counted(docs), 1)

    def delete(self, docs: DataFrame) -> None:
        """Deletions are checked against content too: what isn't live is not written."""
        if self.steps:
            asked = _counted(docs)
            self._write(asked.join(self._known(asked).withColumnRenamed("t", "text"), "text").select("text", F.least("n", "left").alias("n")), -1)

    def _known(self, docs: DataFrame) -> DataFrame:
        """t and left: those texts of docs that are live, and how often."""
        log = self.spark.read.schema("h long, text string, step int, n long, bucket int").parquet(self.folder)
        asked = docs.where(docs["text"].isNotNull()).select(F.xxhash64("text").alias("h"), F.lit(None).cast("int").alias("step"), F.lit(0).cast("long").alias("n")).distinct()
        slim = log.select("h", "step", "n").unionByName(asked).repartition(parts(self.spark), "h").sortWithinPartitions(F.col("step").asc_nulls_last())
        hits = slim.mapInArrow(_replayed, "hit long").distinct()
        # content: only of the digests that hit
        return log.join(hits, F.col("h") == F.col("hit"), "left_semi").groupBy(F.col("text").alias("t")).agg(F.sum("n").alias("left")).where("left > 0")

    def live(self, docs: DataFrame) -> DataFrame:
        """doc_id and live of every row of docs."""
        own = docs.select("doc_id", "text")
        if not self.steps:
            return own.select("doc_id", F.lit(False).alias("live"))
        return own.join(self._known(own), F.col("text") == F.col("t"), "left").select("doc_id", F.col("t").isNotNull().alias("live"))

    def drop(self) -> None:
        remove(self.folder)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.where(docs["text"].isNotNull()).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _replayed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, step, n) in the order of steps, then the digests asked for (step null): those that the filter holds."""
    index = CuckooFilter(1 << 14)
    for batch in rows:
        keys, n = batch.column(0).to_numpy(zero_copy_only=False).view(U64), batch.column(2).to_numpy(zero_copy_only=False)
        step = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        for s in np.unique(step[step > 0]).tolist():
            for sign, apply in ((1, index.insert), (-1, index.delete)):
                own = (step == s) & (n * sign > 0)
                apply(np.repeat(keys[own], np.abs(n[own])))
        asked = keys[step == 0]
        hit = asked[index.contains(asked)] if len(asked) else asked
        if len(hit):
            yield pa.record_batch([pa.array(hit.view(np.int64))], names=["hit"])
