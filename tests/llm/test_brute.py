"""Operators that SQL can't express, against plain versions on small or generated data."""

from __future__ import annotations

import gzip
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from folioscan.llm import common, exact_dedup, html_lstm, langid, minhash, sharding, spm, substring, warc

SF = "/root/testdata/sf0.01"


def _field(tag: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(tag << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(tag << 3) + varint(value)


def unigram_model(fallback: bool) -> bytes:
    """A unigram model written by hand, not trained."""
    rng = np.random.default_rng(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else [])
    texts = [*"abcdefghij", "▁", "ab", "abc", "bca", "cab", "▁a", "▁ab", "▁abc", "de", "def", "efg", "ghij", "▁de", "ij", "aaaa", "aa"]
    pieces += [(t, float(np.float32(-rng.random() * 9 - 1)), 1) for t in texts]
    out = b"".join(_field(1, _field(1, t.encode()) + b"\x15" + np.float32(s).tobytes() + (_field(3, k) if k != 1 else b"")) for t, s, k in pieces)
    trainer = _field(3, 1) + (_field(35, 1) if fallback else b"")
    return out + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_ids_are_the_library_s(fallback):
    raw = unigram_model(fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), spm.Codec(spm.read_model(raw))
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij  xé"), rng.integers(0, 40))) for _ in range(300)] + ["", " ", "abc" * 400, "x", "xyx a"]
    ids, n = own.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [library.encode(t) for t in texts]


def test_long_and_unspaced_texts_and_decoding(spark, monkeypatch):
    monkeypatch.setattr(spm, "PART", 900)
    monkeypatch.setattr(spm, "CHARS", 2000)
    library, c = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL), spm.codec()
    rng = np.random.default_rng(1)
    texts = ["a" * 5000, "".join(chr(x) for x in rng.integers(0x4E00, 0x9FFF, 3000)), " ".join(pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:6]), "b64" + "".join(rng.choice(list("abcXYZ019+/"), 6000)), "two  spaces   here "]
    for t in texts:
        ids, n = c.encode([t])
        assert ids.tolist() == library.encode(t) and c.decode(ids, n) == [t]
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, spm.decode(spm.encode(docs)).collect())) == [(1, "some text"), (2, None), (3, "")]


def test_models_that_change_their_text_are_refused():
    for spec in (_field(2, b"map") + _field(4, 0), _field(4, 1), _field(3, 0) + _field(4, 0)):
        with pytest.raises(ValueError):
            spm.read_model(_field(1, _field(1, b"a")) + _field(3, spec))


def test_the_parse_doesn_t_depend_on_where_it_begins(monkeypatch):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:300]
    model = langid.fit([(d["lang"], d["text"][:1500]) for d in docs[:150]])
    texts = [d["text"] for d in docs[150:]] + ["aaaa" * 900, "zq" * 2000, "", "a", " ".join(d["text"] for d in docs[:40])]
    wanted = [[model._plain(j, model.symbols([t])[0].tolist()) for j in range(len(model.languages))] for t in texts]
    for block in (64, 1024, 1 << 30):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert model.phrases(texts)[0].tolist() == wanted


def test_language_of_documents_that_no_sample_holds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = langid.labelled(docs)
    model, pieces = langid.fit(samples), {t for _, t in samples}
    told = langid.identify(docs, model).join(docs.select("doc_id", "text", "lang"), "doc_id").where("letters >= 100").collect()
    held = [r["lang"] == r["lang_id"] for r in told if not any(p in r["text"] for p in pieces)]
    assert len(held) > 400 and np.mean(held) > 0.97


def test_rows_without_labels_are_kept_and_null_rows_decide_by_their_text(spark):
    rows = [(1, "some words here"), (None, "more words there"), (2, "12 34"), (2, "these stay though the id repeats"), (3, None), (None, "!!")]
    kept = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == ["more words there", "some words here", "these stay though the id repeats"]


def test_groups_by_brute_force_also_where_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (8, minhash.K), dtype=np.uint16)
    sigs = np.repeat(base, 6, axis=0)
    for i, s in enumerate(sigs):
        at = rng.choice(minhash.K, rng.integers(0, 34), replace=False)
        s[at] = rng.integers(0, 1 << 16, len(at), dtype=np.uint16)
        if i % 3 == 0:
            s[:6] = base[0][:6]
    sigs = np.unique(sigs, axis=0)
    near = (sigs[:, None, :] != sigs[None, :, :]).sum(axis=2) <= minhash.RADIUS
    wanted = np.arange(len(sigs))
    for _ in sigs:
        wanted = np.where(near, wanted[None, :], len(sigs)).min(axis=1)
    monkeypatch.setattr(minhash, "HOT", 6)
    monkeypatch.setattr(minhash, "SAMPLED", 1)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id long, sig binary")
    root = {r["id"]: r["root"] for r in minhash.components(minhash.edges(df)).collect()}
    assert [root.get(i, i) for i in range(len(sigs))] == wanted.tolist()


def test_near_copies_go_by_text_whatever_their_ids(spark):
    words = [f"w{i}" for i in range(120)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    rows = [(5, a, 1), (None, b, 2), (7, c, 3), (7, a, 4), (None, None, 5), (8, None, 6), (9, c, 7), (5, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    assert sorted(r["sig"] for r in minhash.keep_one(docs).collect()) == [1, 3, 5, 6]
    assert sorted((r["doc_id"] or 0, r["group_id"] or 0) for r in minhash.groups(docs).collect()) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 5), (7, 7), (8, 8), (9, 7)]


HIGH = (1 << 63) - 1


@pytest.mark.parametrize("keys", [[HIGH] * 5, [-HIGH - 1, HIGH, 0, HIGH, None], list(range(400)), [7] * 90 + list(range(-50, 50)), []])
def test_shards_hold_equal_bytes_but_for_single_keys(spark, keys):
    docs = spark.createDataFrame([(k, "x" * (1 + i % 7)) for i, k in enumerate(keys)], "doc_id long, text string")
    got = sharding.shard(docs, shards=4).collect()
    key = lambda k: -HIGH - 1 if k is None else k
    assert sorted(key(r["doc_id"]) for r in got) == sorted(map(key, keys))
    size, most = [0] * 4, {}
    for r in got:
        size[r["shard_id"]] += len(r["text"])
        most[key(r["doc_id"])] = most.get(key(r["doc_id"]), 0) + len(r["text"])
    order = sorted((key(r["doc_id"]), r["shard_id"]) for r in got)
    assert [s for _, s in order] == sorted(s for _, s in order)
    want = sum(size) / 4
    edge = np.cumsum(size)[:-1]
    assert all(abs(e - want * (i + 1)) <= max([sharding.TOLERANCE * want, *most.values()]) for i, e in enumerate(edge))


def test_a_key_without_an_order_of_numbers_is_refused(spark):
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_intervals_of_repeats_in_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 40)
    words = [f"w{i}" for i in range(300)]
    own = " ".join(words[:50])
    texts = [own, own, " ".join(words[100:160] + ["gap"] + words[100:160]), " ".join(words[200:249]), own + " tail", "", None]
    got = substring.intervals(spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 50), (1, 0, 50), (2, 0, 60), (2, 61, 121), (4, 0, 50)]


def test_lstm_gradient_and_hidden_regions(spark):
    model = html_lstm.Model.new()
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(5, 3, html_lstm.TAGS + html_lstm.WORDS + html_lstm.FIGURES)).astype(np.float32), np.ones((5, 3), dtype=np.float32)
    mask[3:, 1] = 0
    y = rng.integers(0, 2, (5, 3)).astype(np.float32)

    def loss() -> float:
        score = model.forward(x, mask)[0].astype(np.float64)
        return float(((np.logaddexp(0, score) - y * score) * mask).sum() / mask.sum())

    for a, g in zip(model.arrays(), model.gradient(x, mask, y), strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        held, step = a[i], 1e-2
        a[i] = held + step
        up = loss()
        a[i] = held - step
        assert abs((up - loss()) / (2 * step) - g[i]) < 0.02 * abs(g[i]) + 1e-4
        a[i] = held
    # held-out pages, their region tags taken out: labelled as the tags said
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(1500)
    fitted = html_lstm.sample(pages)
    held_out = [p for p in (r["html"] for r in pages.collect()) if p and html_lstm.regioned(p) and p not in set(fitted)][:200]
    parsed = [html_lstm.blocks(p) for p in held_out]
    bare = [[(tuple(t for t in path if t not in html_lstm.REGIONS), text, linked) for path, text, linked in p] for p in parsed]
    for trained, least in ((html_lstm.fit(fitted), 0.97), (html_lstm.fit([]), 0.6)):
        right = np.concatenate([k == np.array([bool(html_lstm.label(path)) for path, *_ in p]) for k, p in zip(html_lstm.classify(trained, bare), parsed, strict=True)])
        assert right.mean() > least


def test_awkward_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>open <div>more"), (None, "<p>a</p>" * 3000), (3, "<p>open <div>more"), (4, "no tags")]
    pages = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    got = html_lstm.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_blocks"]) for r in got) == [(0, 3000), (1, 0), (2, 0), (3, 2), (3, 2), (4, 1)]
    assert html_lstm.extract(pages.where("1 = 0")).count() == 0


def test_warc_records_have_all_fields(spark):
    pages = spark.createDataFrame([(1, "http://WWW.a.example:80/x y#f", "<p>é</p>"), (1, "http://www.a.example/x y", None), (None, None, ""), (2, "https://b.example", "z")], "page_id long, url string, html string")
    lines, folder = warc.archive(pages)
    fs, root = common.filesystem(folder)
    ids = set()
    for r in lines.collect():
        with fs.open_input_file(f"{root}/{r['file']}") as f:
            head, _, rest = gzip.decompress(f.read_at(r["length"], r["offset"])).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == "response" and fields["WARC-Target-URI"]
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        assert int(fields["Content-Length"]) == len(rest) - 4
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == 4
    with fs.open_input_file(f"{root}/{r['file']}") as f:
        assert b"WARC-Type: warcinfo" in gzip.decompress(f.read_at(r["offset"], 0))[:60] or r["offset"] > 0
    common.remove(folder)
    got = warc.captures_of(pages).collect()
    assert sorted((r["page_id"] or 0, r["url_key"], r["n_captures"]) for r in got) == [(0, "", 1), (1, "example,a)/x y", 2), (1, "example,a)/x y", 2), (2, "example,b)/", 1)]
    assert warc.captures_of(pages.where("1 = 0")).count() == 0


def test_text_index_inserts_and_deletes(spark):
    index = exact_dedup.TextIndex(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    live = lambda: [r["doc_id"] for r in sorted(index.live(docs).where("live").collect())]
    assert live() == []
    index.insert(docs)
    assert live() == [1, 2, 3, 5]
    index.delete(docs.where("doc_id in (1, 2)"))
    index.delete(docs.where("doc_id = 1"))
    assert live() == [2, 3, 5]
    index.delete(docs.where("doc_id = 3"))
    index.insert(docs.where("doc_id = 1"))
    assert live() == [1, 5]
    index.drop()


def test_digests_that_clash_are_told_apart_by_content(spark, monkeypatch):
    clash = lambda *c: exact_dedup.F.length(c[0]).cast("long")
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x"), (5, "cd")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", clash)
    assert sorted(map(tuple, exact_dedup.copies(docs).collect())) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 4, 1), (5, 2, 2)]
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(docs).collect()) == [1, 2, 4]
