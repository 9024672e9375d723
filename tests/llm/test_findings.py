"""What a review of the operators found missing."""

from __future__ import annotations

import numpy as np

from folioscan.llm import decontam, html_lstm, langid, licenses
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_license_notices_are_found_across_lines_in_prose_and_in_full(spark):
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(15))
    full = dict(licenses.full_texts())
    texts = [f"import os\n{GPL_HEADER}\n{code}", "The tool that we describe here is released under the MIT License so please use it", full["MIT"], code, "", None, "Copyright 2020 A B\n\n" + full["BSD-3-Clause"], code + "\n" + full["Apache-2.0"]]
    got = licenses.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    best = {(r["doc_id"], r["license"]): (r["first_line"], r["last_line"], r["dice"]) for r in got}
    assert best[0, "GPL-3.0"] == (2, 5, 1.0) and best[1, "MIT"] == (1, 1, 1.0) and best[2, "MIT"][2] == 1.0
    assert best[6, "BSD-3-Clause"][2] == 1.0 and best[7, "Apache-2.0"][2] == 1.0
    assert not {i for i, _ in best} & {3, 4, 5}


def test_license_passages_by_brute_force():
    """Every run of words within the size bounds, by plain sets."""
    words = "a released b under the mit license c under the mit license released under d the mit license".split()
    template, t = [("MIT", "released under the mit license")], 0.6
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    own = pairs(template[0][1].split())
    wanted = max(2 * len(pairs(words[a:b]) & own) / (len(pairs(words[a:b])) + len(own)) for a in range(len(words)) for b in range(a + 2, min(len(words), a + 1 + int(len(own) * (2 - t) / t)) + 1))
    assert [(r, n, d) for r, n, _, _, d in licenses.Passages(template, t).find([" ".join(words)])] == [(0, "MIT", round(wanted, 6))]


def test_license_passages_hold_all_that_the_scan_finds(spark):
    scanned = {(r["doc_id"], r["license"]) for r in QUERIES["op8_license_scan"](spark, SF).collect()}
    assert scanned <= {(r["doc_id"], r["license"]) for r in QUERIES["op8_license_passages"](spark, SF).collect()}


def _written(rng, first: int, n_letters: int, words: int = 300):
    """A writer of words of a made-up language with n_letters letters from first on, the common ones repeated."""
    lexicon = ["".join(chr(first + int(c)) for c in rng.integers(0, n_letters, rng.integers(2, 5))) for _ in range(150)]
    return lambda: " ".join(lexicon[i] for i in np.minimum(rng.zipf(1.4, words) - 1, 149))


def test_every_letter_of_every_script_has_its_symbol():
    rng = np.random.default_rng(4)
    scripts = {"cyr": (0x430, 32), "han": (0x4E00, 900), "hangul": (0xAC00, 700), "lat": (97, 26), "past": (0x20000, 300)}
    write = {lang: _written(rng, *v) for lang, v in scripts.items()}
    model = langid.fit([(lang, w()) for lang, w in write.items() for _ in range(20)])
    told = {lang: model.entropy([w() for _ in range(5)])[0] for lang, w in write.items()}
    for lang, bits in told.items():
        assert [model.languages[j] for j in bits.argmin(axis=1)] == [lang] * 5
        assert (bits.min(axis=1) < 6).all()
    seen = {c for w in write.values() for c in w() if c != " "}
    assert all(model.symbols([c])[1][0] == 1 for c in seen)


def test_the_table_parses_as_a_plain_search_does():
    rng = np.random.default_rng(5)
    write = _written(rng, 0x4E00, 40)
    own = [write() for _ in range(4)]
    sample = " ".join(own)
    model = langid.fit([("x", t) for t in own])
    text = write()[:900]
    n, phrase = 1, ""
    for c in text:
        if phrase + c in sample:
            phrase += c
        else:
            n, phrase = n + 1, c if c in sample else ""
    assert model.phrases([text])[0][0, 0] == n


UNLABELLED = {
    "it": "Il governo ha annunciato ieri che le nuove regole entreranno in vigore dal prossimo mese, dopo una lunga discussione con i sindacati e le imprese della regione.",
    "pt": "O governo anunciou ontem que as novas regras entram em vigor no próximo mês, depois de uma longa discussão com os sindicatos e as empresas da região.",
    "nl": "De regering heeft gisteren aangekondigd dat de nieuwe regels volgende maand ingaan, na een lange discussie met de vakbonden en de bedrijven in de regio.",
    "pl": "Rząd ogłosił wczoraj, że nowe przepisy wejdą w życie w przyszłym miesiącu, po długiej dyskusji ze związkami zawodowymi i firmami z regionu.",
    "tr": "Hükümet dün yaptığı açıklamada yeni kuralların gelecek ay yürürlüğe gireceğini söyledi ve uzun tartışmalardan sonra karar verildi.",
}


def test_unlabelled_languages_are_rejected_and_held_out_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = langid.labelled(docs)
    model = langid.fit(samples)
    foreign = spark.createDataFrame(list(enumerate(UNLABELLED.values())), "doc_id long, text string")
    assert [(r["lang_id"], r["accepted"]) for r in langid.identify(foreign, model).collect()] == [("und", False)] * len(UNLABELLED)
    pieces = {t for _, t in samples}
    told = langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("letters >= 40").collect()
    held = [r["accepted"] for r in told if not any(p in r["text"] for p in pieces)]
    assert len(held) > 500 and np.mean(held) > 0.99


def test_without_held_out_text_nothing_with_letters_is_rejected():
    model = langid.fit([("en", "a few words only")])
    assert np.isinf(model.limits).all()


def test_edited_passages_and_short_items_are_found(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps under the ancient tree until the morning light"
    edited = item.replace("ancient", "withered")
    cropped = item[: int(len(item) * 0.93)]
    texts = [f"before {edited} after", f"before {cropped}", "So: What is TWO plus two? Four.", "somewhat is two plus twofold", f"x {item.replace('quick brown', 'slow grey').replace('lazy dog', 'tall cat')} y", "what is two plus two\nand what is two plus two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "What is two plus two?"), (3, "?!"), (4, "What is two plus two"), (5, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["stop"]) for r in decontam.matches(docs, bench).collect()}
    assert sorted(got) == [(0, 1), (1, 1), (2, 2), (2, 4), (5, 2), (5, 4)]
    assert got[2, 2] == (0, 3, 23) and got[5, 4] == (0, 0, 20)
    assert 5 < got[0, 1][0] <= len(item) // 10


def test_decontamination_against_plain_edit_distance():
    """Every pair that approximate matching by dynamic programming finds, and no other."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(60)]
    items = [(j, " ".join(rng.choice(words, n))) for j, n in enumerate((7, 9, 12, 25, 40, 2, 3))]
    texts = []
    for _, item in items * 3:
        chars = list(item)
        for _ in range(int(rng.integers(0, max(1, len(chars) // 6)))):
            at = int(rng.integers(0, len(chars)))
            chars[at : at + 1] = [[], ["z"], [chars[at], "q"]][rng.integers(0, 3)]
        texts.append(" ".join(rng.choice(words, 30)) + " " + "".join(chars) + " " + " ".join(rng.choice(words, 30)))

    def least(item: str, text: str) -> int:
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    plain = [" ".join(t.split()) for t in texts]
    wanted = {}
    for r, text in enumerate(plain):
        for j, item in items:
            if len(item) < decontam.MIN_ITEM:
                if f" {item} " in f" {text} ":
                    wanted[r, j] = 0
            elif (d := least(item, text)) <= int(decontam.RATE * len(item)):
                wanted[r, j] = d
    index = decontam.index_of(items)
    assert {(r, index.ids[j]): d for r, j, d, _, _ in decontam.search(index, texts)} == wanted and len(wanted) > 10


def test_the_html_model_is_fitted_on_pages_with_regions(spark):
    bare = '<html><body><div class="box"><p>Some words of page {}.</p></div></body></html>'
    full = "<html><body><nav><p>Menu {}</p></nav><article><p>Some words of page {}.</p></article></body></html>"
    rows = [(i, full.format(i, i) if i % 10 == 0 else bare.format(i)) for i in range(1000)] + [(2000, None), (2001, "")]
    got = html_lstm.sample(spark.createDataFrame(rows, "page_id long, html string"))
    assert sorted(got) == sorted(h for i, h in rows if h and i % 10 == 0)
