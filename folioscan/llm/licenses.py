"""License scans (8): Dice coefficient over word bigrams against licence templates.

Units are every line of a text and, where it has several lines, the whole text
(line_no 0). A unit and a template are compared as sets of bigrams of normalised
words (lower-cased runs of letters and digits). For a coefficient of THRESHOLD
the larger of two sets has at most (2 - t) / t times the smaller one's size, so a
unit of n bigrams is only compared with templates between n * t / (2 - t) and
n * (2 - t) / t, found in the list sorted by size; and at least t / 2 of its own
bigrams must stand in some template, which one table lookup for each bigram of
the batch tells.

Defined results: null and empty texts and units of under two words match nothing;
every template at or over the threshold is told; rows that repeat an id are told
for each row; lines are cut at newlines only.

These units are what the query's SQL compares; a notice wrapped over lines of a
longer file, one inside a line of prose and full licence texts (license_texts/)
are found by passages(): runs of words anywhere in a text. A run begins and ends
with a bigram of the template and holds at most n * (2 - t) / t bigrams for its n,
and every such run is compared, by sets as above. It gives a row for each row of
docs and licence, with the best run; of equally good ones the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, grouped_words, mix, portions, share

THRESHOLD = 0.7

#: Normalised wording of licence notices and short licences, in our own selection.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "this project is licensed under the apache license 2 0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("Apache-2.0", "spdx license identifier apache 2 0"),
    ("MIT", "released under the mit license"),
    ("MIT", "this project is licensed under the mit license"),
    ("MIT", "licensed under the mit license see license for details"),
    ("MIT", "spdx license identifier mit"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-3.0", "spdx license identifier gpl 3 0 or later"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-2.0", "spdx license identifier gpl 2 0 only"),
    ("LGPL-3.0", "this library is licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "this work is licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("BSD-3-Clause", "released under the bsd 3 clause license"),
    ("BSD-3-Clause", "spdx license identifier bsd 3 clause"),
    ("BSD-2-Clause", "released under the bsd 2 clause license"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CC-BY-ND-4.0", "licensed under cc by nd 4 0"),
]


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * U64(0x9DDFEA08EB382D69) + words[1:])


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        h, off = grouped_words([t for _, t in templates])
        sets = [np.unique(bigrams(h[off[i] : off[i + 1]])) for i in range(len(templates))]
        order = sorted((len(s), i) for i, s in enumerate(sets) if len(s))
        self.t = threshold
        self.size = np.array([n for n, _ in order])
        self.name = [templates[i][0] for _, i in order]
        self.sets = [set(sets[i].tolist()) for _, i in order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        for s in sets:
            self.maybe[s >> U64(42)] = True

    def scan(self, texts: list[str]) -> list[tuple[int, int, str, float]]:
        """(row, line_no, licence, Dice coefficient), the best of a licence's templates."""
        units, owner, line = [], [], []
        for r, t in enumerate(texts):
            own = t.split("\n")
            units += own
            owner += [r] * len(own)
            line += range(1, len(own) + 1)
        h, off = grouped_words(units)
        if len(h) < 2:
            return []
        pair = bigrams(h)
        inside = np.ones(len(pair), dtype=bool)
        inside[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(h))] - 1] = False
        known = self.maybe[pair >> U64(42)]
        per_line, per_text = np.concatenate(([0], np.cumsum(known & inside))), np.concatenate(([0], np.cumsum(known)))
        owner_, line_ = np.array(owner), np.array(line)
        spans = [(off[:-1], off[1:], owner_, line_, per_line)]
        edge = np.searchsorted(owner_, np.arange(len(texts) + 1))
        many = np.flatnonzero(np.diff(edge) > 1)
        spans.append((off[edge[many]], off[edge[many + 1]], many, np.zeros(len(many), dtype=np.int64), per_text))
        out = []
        least = self.size[0] if len(self.size) else 0
        most = self.size[-1] * (2 - self.t) / self.t if len(self.size) else 0
        for start, end, row, no, upto in spans:
            n = end - start - 1  # bigrams, those across lines of a whole text among them
            hits = upto[np.maximum(end - 1, 0)] - upto[np.minimum(start, len(pair))]
            # a match holds at least t / 2 * (its own set + the smallest template) bigrams of templates
            for i in np.flatnonzero((n >= 1) & (hits >= self.t / 2 * (1 + least))).tolist():
                own = set(pair[start[i] : end[i] - 1].tolist())
                if len(own) > most:
                    continue
                lo, hi = np.searchsorted(self.size, [len(own) * self.t / (2 - self.t) - 1e-9, len(own) * (2 - self.t) / self.t + 1e-9])
                best: dict[str, float] = {}
                for j in range(lo, hi):
                    dice = 2 * len(own & self.sets[j]) / (len(own) + len(self.sets[j]))
                    if dice >= self.t:
                        best[self.name[j]] = max(best.get(self.name[j], 0.0), dice)
                out += [(int(row[i]), int(no[i]), name, round(d, 6)) for name, d in best.items()]
        return out


SCHEMA = "doc_id long, line_no long, license string, dice double"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, license, dice."""
    spark = docs.sparkSession
    batches(spark)
    shared = share(spark, Templates(templates or TEMPLATES, threshold))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in rows for p in portions(batch)):
            ids = part.column(0).to_pylist()
            if got := shared.value.scan([t or "" for t in part.column(1).to_pylist()]):
                yield pa.record_batch([pa.array([ids[g[0]] for g in got], pa.int64()), *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.float64())))], names=["doc_id", "line_no", "license", "dice"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the licences that license_texts/ holds."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


class Passages:
    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        h, off = grouped_words([t for _, t in templates])
        sets = [np.unique(bigrams(h[off[i] : off[i + 1]])) for i in range(len(templates))]
        self.t = threshold
        self.name = [name for name, _ in templates]
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        key, template = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(key, kind="stable")
        self.key, self.template = key[order], template[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[key >> U64(42)] = True

    def find(self, texts: list[str]) -> list[tuple[int, str, int, int, float]]:
        """(row, licence, first and last line, Dice coefficient), the best run of a row and licence."""
        lines = [t.split("\n") for t in texts]
        h, off = grouped_words([x for own in lines for x in own])
        if len(h) < 2:
            return []
        first_line = np.concatenate(([0], np.cumsum([len(own) for own in lines])))
        begin = off[first_line]
        pair = bigrams(h)
        known = self.maybe[pair >> U64(42)]
        known[begin[1:-1][(begin[1:-1] > 0) & (begin[1:-1] < len(h))] - 1] = False
        at = np.flatnonzero(known)
        lo, hi = np.searchsorted(self.key, pair[at], side="left"), np.searchsorted(self.key, pair[at], side="right")
        n = hi - lo
        src = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, template = np.repeat(at, n), self.template[src]
        row = np.searchsorted(begin, at, side="right") - 1
        group = row * len(self.name) + template
        order = np.lexsort((at, group))
        at, group = at[order], group[order]
        names, start, count = np.unique(group, return_index=True, return_counts=True)
        # 2 d >= t * (own + n) with own >= d: so many of a template's bigrams at least
        need = np.ceil(self.t * self.size / (2 - self.t) - 1e-9).astype(np.int64)
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        before = None
        for k in np.flatnonzero(count >= need[names % len(self.name)]).tolist():
            r, j = divmod(int(names[k]), len(self.name))
            p, size = at[start[k] : start[k] + count[k]], int(self.size[j])
            stop = np.searchsorted(p, p + int(size * (2 - self.t) / self.t + 1e-9), side="left")
            for i in np.flatnonzero(stop - np.arange(len(p)) >= need[j]).tolist():
                if before is None:
                    before = _before(pair)
                run, a = p[i : stop[i]], int(p[i])
                shared = np.cumsum(before[run] < a)
                if shared[-1] < need[j]:
                    continue
                own = np.cumsum(before[a : run[-1] + 1] < a)[run - a]
                dice = 2 * shared / (own + size)
                e = int(np.argmax(dice))
                held = best.get((r, self.name[j]))
                if dice[e] >= self.t and (held is None or dice[e] > held[0]):
                    best[r, self.name[j]] = (float(dice[e]), a, int(run[e]) + 1)
        # words a .. b: the lines that hold them
        line = lambda r, w: int(np.searchsorted(off, w, side="right") - first_line[r])
        return [(r, name, line(r, a), line(r, b), round(d, 6)) for (r, name), (d, a, b) in sorted(best.items())]


def _before(pair: np.ndarray) -> np.ndarray:
    """Where each bigram stood last before, or -1."""
    order = np.argsort(pair, kind="stable")
    out = np.full(len(pair), -1, dtype=np.int64)
    again = np.flatnonzero(pair[order][1:] == pair[order][:-1])
    out[order[again + 1]] = order[again]
    return out


PASSAGES = "doc_id long, license string, first_line long, last_line long, dice double"


def passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, first_line, last_line, dice."""
    spark = docs.sparkSession
    batches(spark)
    shared = share(spark, Passages(TEMPLATES + full_texts(), threshold))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in rows for p in portions(batch)):
            ids = part.column(0).to_pylist()
            if got := shared.value.find([t or "" for t in part.column(1).to_pylist()]):
                yield pa.record_batch([pa.array([ids[g[0]] for g in got], pa.int64()), *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "license", "first_line", "last_line", "dice"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PASSAGES)
