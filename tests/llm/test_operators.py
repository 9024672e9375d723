"""Operators against brute force, and the defined results of awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
import sentencepiece

from folioscan.llm import decontam, exact_dedup, langid, licenses, minhash, sharding, spm, substring

SF = "/root/testdata/sf0.001"
#: null texts and ids, empty and long ones, rows that repeat, extra columns with clashing names.
ROWS = [(1, "one two three four", "a"), (2, "one two three four", "b"), (2, "one two three four", "b"), (3, None, "c"), (4, "", "d"), (4, "", "d"), (None, "five six", "e"), (None, None, None), (5, "word " * 30_000, "f"), (6, "é中\u0000 \U0001f600", "g")]
SCHEMA = "doc_id long, text string, hit string, h string, bucket string, key string"


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame([(i, t, x, x, x, x) for i, t, x in ROWS], SCHEMA)


def test_cuckoo_filter_holds_deletes_and_grows():
    index, keys = exact_dedup.CuckooFilter(16), np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    index.insert(keys)
    assert index.contains(keys).all() and index.resizes > 0
    assert index.delete(keys[:1000]).all() and not index.delete(keys[:10]).any()
    assert index.contains(keys[1000:]).all() and index.contains(keys[:1000]).mean() < 0.01


def test_exact_dedup_of_awkward_rows(awkward):
    assert sorted(map(str, (tuple(r) for r in exact_dedup.copies(awkward).collect()))) == sorted(map(str, [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 2), (4, 4, 2), (None, None, 1), (None, None, 1), (5, 5, 1), (6, 6, 1)]))
    kept = exact_dedup.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == 7


def test_minhash_keys_connect_every_pair_in_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (8, minhash.K), dtype=np.uint16)
    sigs = np.repeat(base, 6, axis=0)
    for s in sigs[1::2]:
        at = rng.choice(minhash.K, rng.integers(0, 40), replace=False)
        s[at] = rng.integers(0, 1 << 16, len(at), dtype=np.uint16)
    sigs = np.unique(sigs, axis=0)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id long, sig binary")
    root = {r["id"]: r["root"] for r in minhash.components(minhash.edges(df)).collect()}
    near = (sigs[:, None, :] != sigs[None, :, :]).sum(axis=2) <= minhash.RADIUS
    for i, j in zip(*np.nonzero(near), strict=True):
        assert root.get(i, i) == root.get(j, j)
    reach = near.copy()
    for _ in range(len(sigs)):
        reach = (reach.astype(int) @ near.astype(int)) > 0
    assert all(reach[i, r] for i, r in root.items())


def test_sentencepiece_gives_the_library_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in spm.encode(docs).collect():
        assert r["token_ids"] == library.encode(texts[r["doc_id"]])


def test_substring_intervals_by_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:120]), " ".join(words[200:260] + words[30:100]), " ".join(words[300:]), "", None]
    got = substring.intervals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 30, 100), (1, 60, 130)]


def test_decontamination_finds_edits_within_the_budget(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree until the morning"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "before " + item.replace("brown", "brawn").replace("lazy", "lzy") + " after"), (3, "before " + item[: len(item) // 2]), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.matches(docs, bench).collect()) == [(1, 7, 0), (2, 7, 2)]


def test_shards_keep_rows_and_order(spark):
    got = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), shards=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard_id"], []).append(r)
    assert sorted(by) == [0, 1, 2, 3]
    for a, b in zip(range(3), range(1, 4), strict=True):
        assert max(r["doc_id"] for r in by[a]) < min(r["doc_id"] for r in by[b])


@pytest.mark.parametrize("run", [spm.encode, minhash.groups, langid.identify, sharding.shard])
def test_a_row_for_each_awkward_row(awkward, run):
    df = awkward.withColumnRenamed("hit", "lang")
    assert run(df).count() == len(ROWS)
    assert run(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("run", [licenses.scan, substring.intervals, exact_dedup.copies])
def test_empty_tables(awkward, run):
    assert run(awkward.where("1 = 0")).count() == 0
