"""run() against a pipeline in plain Python over a small table with copies, passages, junk and awkward rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from folioscan.llm import decontam, langid, minhash, spm

from ..compare import TABLES

SF = "/root/testdata/sf0.001"


def sellers(item: np.ndarray, text: np.ndarray) -> int:
    """Least edits of item against any part of text, a whole row of the table at a time."""
    row, place = np.zeros(len(text) + 1, dtype=np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[:8]
    docs = [d for d in docs if d["text"] and len(d["text"]) < 4000][:70]
    row = lambda i, t, lang="en": {"doc_id": i, "text": t, "lang": lang, "source": "hot", "n_chars": len(t or "")}
    long_ = next(d["text"] for d in docs if len(d["text"].split()) > 150 and d["lang"] == "en")
    words = long_.split()
    edited = items[0]["text"][:20] + "x" + items[0]["text"][21:]
    docs += [row(9001, long_), row(9000, long_), row(None, long_), row(9002, " ".join([*words[:-1], "other"])), row(9003, " ".join(["First", *words[1:]]))]
    docs += [row(9010, f"{long_[:400]} {items[1]['text']} {long_[-300:]}"), row(9011, f"{long_[50:300]} {edited}"), row(None, f"And {items[2]['text']} too")]
    docs += [row(9020, "12 34 %% 56"), row(9021, ""), row(9022, None), row(9023, "қўғ ҳфщ " * 40), row(9024, "Пять слов на другом языке " * 9)]
    docs += [row(9030, long_[600:900]), row(9030, long_[100:500]), row(None, None)]
    pq.write_table(pa.Table.from_pylist(docs), at / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(items), at / "benchmark.parquet")
    for t in TABLES:
        if not (at / f"{t}.parquet").exists():
            (at / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return str(at)


def brute(spark, folder: str) -> list[tuple]:
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    items = [decontam.normalised([r["text"]])[0][:-1] for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    model = langid.fit(langid.labelled(spark.read.parquet(f"{folder}/documents.parquet")))

    def known(text: str | None) -> bool:
        symbols = model.symbols([text or ""])[0].tolist()
        if not symbols:
            return False
        bits = [model._plain(j, symbols) * model.bits[j] / len(symbols) for j in range(len(model.languages))]
        best = int(np.argmin(bits))
        at = max(i for i, n in enumerate(langid.LENGTHS) if n <= len(symbols))
        return bits[best] <= model.limits[best, at]

    docs = [d for d in docs if known(d["text"])]
    last = 1 << 62
    key = lambda d: (d["doc_id"] is None, last if d["doc_id"] is None else d["doc_id"])
    first: dict = {}
    for d in sorted(docs, key=key):
        first.setdefault(d["text"], d)
    docs = list(first.values())
    sigs = [np.frombuffer(s, np.uint16) if s else None for s in minhash.signatures_of([d["text"] for d in docs])]
    group = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sigs):
            near = [j for j, b in enumerate(sigs) if a is not None and b is not None and (a != b).sum() <= minhash.RADIUS]
            group[i] = min([group[i], *(group[j] for j in near)])
    kept: dict = {}
    for i in sorted(range(len(docs)), key=lambda i: key(docs[i])):
        kept.setdefault(group[i] if sigs[i] is not None else ("none", i), docs[i])

    def clean(d: dict) -> bool:
        text = decontam.normalised([d["text"]])[0][:-1]
        return not any(len(text) and sellers(m, text) <= int(decontam.RATE * len(m)) for m in items)

    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    return sorted((-1 if d["doc_id"] is None else d["doc_id"], tuple(library.encode(d["text"]))) for d in kept.values() if clean(d))


def test_run_is_the_brute_force_pipeline(spark, folder):
    wanted = brute(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["token_ids"])) for r in got) == wanted
    ids = {r["doc_id"] for r in got}
    assert not ids & {9001, 9002, 9003, 9010, 9011, 9020, 9021, 9022, None} and len(ids) > 40


def test_run_of_an_empty_table(spark, folder, tmp_path):
    docs = pq.read_table(f"{folder}/documents.parquet")
    pq.write_table(docs.slice(0, 0), tmp_path / "documents.parquet")
    (tmp_path / "benchmark.parquet").symlink_to(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id as id", "lang as sig", "text as _sig", "source as root", "n_chars as _twice")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stage(spark, docs, folder), docs
        assert docs.columns == before.columns
    assert docs.count() == corpus_pipeline.run(spark, folder).count()
