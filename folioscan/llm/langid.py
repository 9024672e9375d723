"""Language ID (7): cross-parsing against suffix automata.

Per language a suffix automaton is built over a bounded sample of labelled text
(SAMPLE_DOCS pieces of at most PIECE characters, SAMPLE_CHARS in all). A text is
parsed from left to right into the longest phrases that the sample holds; the
entropy estimate is phrases * log2(sample length) / text length, and the language
with the lowest wins. Every letter of the samples has a symbol of its own, whatever
the script. The automata are laid out as one table in which the transitions of
states lie between one another, and all blocks of a batch take each step together.

Whole texts are parsed, as one parse from end to end. For speed the parse begins at
every BLOCK letters at once; a parse that comes from the block before goes on until
it begins a phrase where the block's own parse does, as from there on the two are
the same, and what the block's own parse found before that place doesn't count. So
the result doesn't depend on BLOCK.

Defined results: null and empty texts, and texts without a letter, have lang_id
'und' and are rejected; ties go to the language that comes first in the alphabet;
a text is rejected if its lowest entropy passes the limit that held-out text of that
language and about that length gives (see _limits()).
With no labelled row at all, or without a column lang, every text is 'und' and
nothing is rejected but texts without letters. Every row is decided by its own text,
whether its id is null or repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHARS, batches, codepoints, filtered, portions, share

SAMPLE_DOCS, PIECE, SAMPLE_CHARS = 48, 1500, 24_000
#: Letters from one beginning to the next (speed only).
BLOCK = 1024
#: Languages parsed side by side (memory only).
TOGETHER = 16
#: Held-out texts are scored in windows of these many letters; a limit needs LEAST windows. Longer
#: texts have the last one's limit: they hold quotes, notices and lists, as the worst of its windows do.
LENGTHS, LEAST = (1, 2, 3, 5, 10, 20, 40, 80), 8
#: A limit lies so many spreads over the median; the spread is at least a share of the median.
SPREADS, LEAST_SPREAD = 4.0, 0.05


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of text."""
    go, link, size = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def letters(text: str) -> str:
    """Lower case, every run of other characters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


_LETTER: np.ndarray | None = None


def _letters_of_unicode() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


@dataclass
class Model:
    languages: list[str]
    lut: np.ndarray  #: symbol of each code point; 1 what is no letter, 0 a letter that no sample has
    table: np.ndarray  #: at state + symbol: the state that the entry belongs to << 32 | the next state, or -1
    fresh: np.ndarray  #: by language and symbol, the state that a new phrase begins with
    roots: np.ndarray
    bits: np.ndarray  #: log2 of each sample's length
    limits: np.ndarray  #: by language and length (LENGTHS), the entropy past which a text is rejected

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, spaces squeezed, and how many belong to each."""
        low = [t.lower() for t in texts]
        codes = codepoints("\n".join(low) + "\n")
        sym = self.lut[codes]
        ends = np.cumsum([len(t) + 1 for t in low])
        space = sym == 1
        keep = ~(space & np.concatenate(([True], space[:-1])))
        # a text's own closing space goes: the new line after it, or the run that it ends
        total = np.concatenate(([0], np.cumsum(keep)))
        at = np.concatenate(([0], ends))
        counts = total[at[1:]] - total[at[:-1]]
        out = sym[keep]
        stops = np.cumsum(counts)
        has = counts > 0
        drop = stops[has] - 1
        closing = out[drop] == 1
        out = np.delete(out, drop[closing])
        counts[np.flatnonzero(has)[closing]] -= 1
        return out, counts

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the number of symbols of each text."""
        sym, counts = self.symbols(texts)
        k = len(self.languages)
        out = np.zeros((len(texts), k), dtype=np.int64)
        if not len(sym) or not k:
            return out, counts
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = (np.cumsum(counts) - counts)[owner] + nth * BLOCK
        sizes = np.minimum(counts[owner] - nth * BLOCK, BLOCK)
        for j in range(0, k, TOGETHER):
            out[:, j : j + TOGETHER] = self._parse(np.arange(j, min(j + TOGETHER, k)), sym, owner, starts, sizes, len(texts))
        return out, counts

    def _parse(self, langs: np.ndarray, sym: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_texts: int) -> np.ndarray:
        """Phrases by text and language of langs."""
        table, fresh, n, k = self.table, self.fresh[langs].ravel(), len(starts), len(langs)
        rows = (np.arange(k) * self.fresh.shape[1])[:, None]
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        active = np.searchsorted(-sizes[order], -np.arange(sizes[order[0]]), side="left")
        first, state = starts[order], np.repeat(self.roots[langs][:, None], n, axis=1)
        count, begun = np.zeros((k, n), dtype=np.int64), []  # begun: by step, which blocks' parses begin a phrase there
        for step, m in enumerate(active.tolist()):
            s = sym[first[:m] + step]
            own = state[:, :m]
            v = table.take(own + s)
            ends = v >> 32 != own
            state[:, :m] = np.where(ends, fresh.take(rows + s), v & 0xFFFFFFFF)
            if not step:
                ends[:] = True
            count[:, :m] += ends
            begun.append(ends)
        state, count = state[:, place], count[:, place]
        # every block's parse goes on into the next block of its text until the two meet
        has_next = np.flatnonzero(owner[1:] == owner[:-1])
        lang, block = np.repeat(np.arange(k), len(has_next)), np.tile(has_next, k)
        live, own = np.arange(len(block)), state[lang, block]
        extra, before, met = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=bool)
        for step in range(len(begun)):
            inside = step < sizes[block[live] + 1]
            if not inside.all():
                live, own = live[inside], own[inside]
            if not len(live):
                break
            j, b = lang[live], block[live] + 1
            s = sym[starts[b] + step]
            v = table.take(own + s)
            ends, theirs = v >> 32 != own, begun[step][j, place[b]]
            same = ends & theirs
            extra[live] += ends & ~same
            before[live] += theirs & ~same
            met[live] = same
            go = ~same
            live, own = live[go], np.where(ends, fresh.take(rows[j, 0] + s), v & 0xFFFFFFFF)[go]
        count[lang, block] += extra
        count[lang, block + 1] -= before
        total = np.zeros((n_texts, k), dtype=np.int64)
        np.add.at(total, owner, count.T)
        # where they don't meet within a block, the text is parsed again from end to end
        for j, text in {(int(lang[r]), int(owner[block[r]])) for r in np.flatnonzero(~met)}:
            blocks = np.flatnonzero(owner == text)
            total[text, j] = self._plain(langs[j], sym[starts[blocks[0]] : starts[blocks[-1]] + sizes[blocks[-1]]].tolist())
        return total

    def _plain(self, j: int, sym: list[int]) -> int:
        """A phrase begins with the first symbol and where no transition is left."""
        state, n, fresh, table = int(self.roots[j]), 0, self.fresh[j].tolist(), self.table
        for i, s in enumerate(sym):
            v = int(table[state + s])
            n += not i or v >> 32 != state
            if v >> 32 != state:
                state = fresh[s]
            else:
                state = v & 0xFFFFFFFF
        return n

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, counts = self.phrases(texts)
        return n * self.bits[None, :] / np.maximum(counts, 1)[:, None], n, counts


def _table(sample: list[int], width: int, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The automaton as a double array whose first place is base: table, fresh and root of Model.

    A state is the place of its symbol 0; the entries of states lie between one another, each
    with its owner. Its size follows the transitions, not states times letters.
    """
    go = suffix_automaton(sample)
    used = np.zeros(4 * len(sample) + 16 * width + 64, dtype=bool)
    place, taken = [0] * len(go), set()
    low = width
    many = sorted((i for i, moves in enumerate(go) if len(moves) > 1), key=lambda i: -len(go[i]))
    for i in many:
        syms, at, found = np.array(sorted(go[i]), dtype=np.int64), low, -1
        while found < 0:
            if at + 512 + width > len(used):
                used = np.concatenate((used, np.zeros(len(used), dtype=bool)))
            free = at + np.flatnonzero(~used[at : at + 512])
            fits = free[~used[(free - syms[0])[:, None] + syms].any(axis=1)] - syms[0]
            found = next((b for b in fits.tolist() if b not in taken), -1)
            at += 512
        place[i] = found
        taken.add(found)
        used[found + syms] = True
        # places that were tried in vain are left to the states of one transition
        low = max(low, at - 1024)
    few = [i for i, moves in enumerate(go) if len(moves) <= 1]
    used = np.concatenate((used, np.zeros(2 * len(few) + 2 * width, dtype=bool)))
    slots = iter((width + np.flatnonzero(~used[width:])).tolist())
    again: list[int] = []  # slots that would have given another state's place
    for i in few:
        sym = next(iter(go[i]), 0)
        k = next((k for k, f in enumerate(again[:8]) if f - sym not in taken), -1)
        if k >= 0:
            f = again.pop(k)
        else:
            while (f := next(slots)) - sym in taken:
                again.append(f)
        place[i] = f - sym
        taken.add(f - sym)
    state = np.array(place, dtype=np.int64)
    table = np.full(int(state.max()) + width, -1, dtype=np.int64)
    fresh = np.full(width, state[0] + base, dtype=np.int64)  # a symbol that the sample lacks ends the phrase at once
    for c, to in go[0].items():
        fresh[c] = state[to] + base
    owner = np.repeat(np.arange(len(go)), [len(m) for m in go])
    syms = np.fromiter((c for m in go for c in m), dtype=np.int64, count=len(owner))
    to = np.fromiter((t for m in go for t in m.values()), dtype=np.int64, count=len(owner))
    table[state[owner] + syms] = (state[owner] + base) << 32 | (state[to] + base)
    return table, fresh, int(state[0]) + base


def fit(samples: list[tuple[str, str]]) -> Model:
    """samples: (language, text) rows. A fifth of each language's is held out for the limits."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        if clean := letters(text):
            by.setdefault(lang, []).append(clean)
    languages = sorted(by)
    seen = sorted({c for v in by.values() for t in v for c in t} - {" "})
    lut = np.where(_letters_of_unicode(), np.int32(0), np.int32(1))
    lut[[ord(c) for c in seen]] = np.arange(len(seen), dtype=np.int32) + 2
    width = len(seen) + 2
    train, held = {}, {}
    for lang in languages:
        own = by[lang]
        kept = [t for i, t in enumerate(own) if i % 5 != 4]
        train[lang] = " ".join(kept)[:SAMPLE_CHARS]
        # what the sample has no room for is held out as well
        room = np.cumsum([len(t) + 1 for t in kept]) - [len(t) + 1 for t in kept] < SAMPLE_CHARS
        held[lang] = own[4::5] + [t for t, inside in zip(kept, room, strict=True) if not inside]
    tables, fresh, roots, base = [], [], [], 0
    for lang in languages:
        table, first, root = _table(lut[codepoints(train[lang])].tolist(), width, base)
        tables.append(table)
        fresh.append(first)
        roots.append(root)
        base += len(table)
    model = Model(languages, lut, np.concatenate(tables) if tables else np.zeros(0, np.int64), np.array(fresh, dtype=np.int64), np.array(roots, dtype=np.int64), np.log2([max(2, len(train[lang])) for lang in languages]) if languages else np.zeros(0), np.full((len(languages), len(LENGTHS)), np.inf))
    if languages:
        model.limits = _limits(model, held)
    return model


def _limits(model: Model, held: dict[str, list[str]]) -> np.ndarray:
    """Shorter texts score higher and spread more, so each length has its own limit. Where a
    language has too few windows of a length, the next shorter one's limit holds; where it has too
    few at all, that of all languages together; without that, nothing is rejected.
    """
    out = np.full((len(model.languages), len(LENGTHS)), np.inf)

    def limit(scores: np.ndarray) -> float:
        # the spread over the median: copies of what the sample holds score low and widen nothing
        mid = float(np.median(scores))
        over = scores[scores > mid] - mid
        return mid + SPREADS * max(LEAST_SPREAD * mid, float(np.sqrt(np.mean(over**2))) if len(over) else 0.0)

    for i, n in enumerate(LENGTHS):
        cut = [[t[at : at + n].strip() for t in held[lang] for at in range(0, len(t) - n + 1, n)] for lang in model.languages]
        scores = [model.entropy(own)[0][:, j] if own else np.zeros(0) for j, own in enumerate(cut)]
        every = np.concatenate(scores)
        for j, own in enumerate(scores):
            if len(own) >= LEAST:
                out[j, i] = limit(own)
            elif i:
                out[j, i] = out[j, i - 1]
            elif len(every) >= LEAST:
                out[j, i] = limit(every)
    return out


def labelled(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: per language the SAMPLE_DOCS lowest hashes of doc_id, a piece of each."""
    if "lang" not in {c.lower() for c in docs.columns}:
        return []
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = ids.withColumn("n", nth).where(F.col("n") <= SAMPLE_DOCS).select(F.col("doc_id").alias("i"), "h", "n").collect()
    if not few:
        return []
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - PIECE, F.lit(1)))
    wanted = docs.where(F.col("doc_id").isin([r["i"] for r in few]) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = wanted.groupBy("doc_id", "lang").agg(F.min(F.substring("text", start, F.lit(PIECE))).alias("t")).collect()
    order = {r["i"]: (r["h"], r["n"]) for r in few}
    return [(r["lang"], r["t"]) for r in sorted(rows, key=lambda r: (r["lang"], order[r["doc_id"]]))]


SCHEMA = "doc_id long, lang_id string, phrases long, letters long, bits double, accepted boolean"


def _told(m: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Language (its place, or that of 'und'), phrases, letters, bits and whether the text is accepted."""
    bits, n, counts = m.entropy(texts)
    if m.languages:
        best = np.argmin(bits, axis=1)
        low, count = bits[np.arange(len(texts)), best], n[np.arange(len(texts)), best]
        most = m.limits[best, np.maximum(np.searchsorted(LENGTHS, counts, side="right") - 1, 0)]
    else:
        best, low, count = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int)
        most = np.full(len(texts), np.inf)
    reject = (low > most) | (counts == 0)
    return np.where(reject | (not m.languages), len(m.languages), best), count, counts, low, ~reject


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_id, phrases, letters, bits (entropy a letter) and accepted, a row for each row of docs."""
    spark: SparkSession = docs.sparkSession
    batches(spark)
    shared = share(spark, model or fit(labelled(docs)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in rows:
            for part in portions(batch, 1, 2 * CHARS):
                best, count, letters_, low, fine = _told(m, [t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(names[best], pa.string()), pa.array(count, pa.int64()), pa.array(letters_, pa.int64()), pa.array(np.round(low, 6)), pa.array(fine)], names=["doc_id", "lang_id", "phrases", "letters", "bits", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows rejected, each decided by its own text; columns as they were."""
    spark = docs.sparkSession
    batches(spark)
    shared = share(spark, model or fit(labelled(docs)))

    def keep(batch: pa.RecordBatch, place: int) -> np.ndarray:
        return np.concatenate([_told(shared.value, [t or "" for t in part.column(place).to_pylist()])[4] for part in portions(batch, place, 2 * CHARS)])

    return filtered(docs, keep)
