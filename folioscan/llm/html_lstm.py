"""HTML extraction (2): a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path
of open tags above it. Each block becomes a vector of hashed tags of its path,
hashed words and six figures (length, share of link text, position and such). A
bidirectional LSTM in numpy reads the whole sequence of a page's blocks, and a
logistic layer labels each block as content or not from both directions' states,
so every decision sees the whole page. Pages of similar length run together.

The model is trained here, on the FIT_PAGES pages with the lowest hash of their
page_id among those with explicit regions (a documented bound; of equal pages one
counts), against labels that pages with explicit regions give: blocks under article
or main are content, blocks under nav, footer, aside, header or an element of class
ad are not, others on such a page are not either. In training, region tags are
hidden on half of the pages, so that the model also labels pages without them. All
blocks of these pages are learnt from; a page of over SEQUENCE blocks is several
training sequences. A table in which no page has regions is labelled by a model
trained on pages made up here (made_up()).

Defined results: null and empty pages have no block and an empty text; a page of
which no block is labelled content has an empty text; malformed markup is read as
far as it can be, an unclosed tag lasts until its parent closes; the longest of
pages are read whole; rows that repeat are labelled each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHARS, U64, batches, grouped_words, portions, share

TAGS, WORDS, FIGURES, HIDDEN = 64, 128, 6, 24
FIT_PAGES, EPOCHS, SEQUENCE = 240, 6, 400
REGIONS = {"article", "main", "nav", "footer", "aside", "header", "div.ad"}
CONTENT, BOILER = {"article", "main"}, {"nav", "footer", "aside", "header", "div.ad"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "small", "code", "u", "sub", "sup", "font", "abbr", "q", "s", "mark", "time", "label", "br", "wbr", "img"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.I | re.S)
_CLASS = re.compile(r"""class\s*=\s*["']?([^"'>]*)""", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) of each leaf block in order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    path: list[str] = []
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((tuple(path), joined, linked))
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if (body := m[5]) is not None:
            text.append(body)
            if links:
                linked += len(body)
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in _INLINE:
            if name == "a":
                links = max(0, links - 1) if m[2] else links + 1
            if name == "br":
                text.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(path) - 1, -1, -1):
                if path[i].split(".")[0] == name:
                    del path[i:]
                    break
            links = 0 if not path else links
        elif name not in _VOID and not m[4].rstrip().endswith("/"):
            if name in ("p", "li", "tr", "td", "option") and path and path[-1].split(".")[0] == name:
                path.pop()
            kind = _CLASS.search(m[4])
            path.append(f"{name}.ad" if kind and "ad" in kind[1].lower().split() else name)
    flush()
    return out


def label(path: tuple[str, ...]) -> int:
    for tag in reversed(path):
        if tag in CONTENT:
            return 1
        if tag in BOILER:
            return 0
    return 0


def features(pages: list[list[tuple[tuple[str, ...], str, int]]], hide: np.ndarray | None = None, within: list[tuple[int, int]] | None = None) -> np.ndarray:
    """A row for each block of all pages. hide: pages whose region tags are left out. within: where
    the blocks begin in their page, and its length, if they are parts of pages.
    """
    flat = [(k, i + (within[k][0] if within else 0), within[k][1] if within else len(p), b) for k, p in enumerate(pages) for i, b in enumerate(p)]
    x = np.zeros((len(flat), TAGS + WORDS + FIGURES), dtype=np.float32)
    if not flat:
        return x
    h, off = grouped_words([b[1] for *_, b in flat])
    n = np.diff(off)
    rows = np.repeat(np.arange(len(flat)), n)
    words = np.bincount(rows * WORDS + (h >> U64(57)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS)
    x[:, TAGS : TAGS + WORDS] = words / np.sqrt(np.maximum(n, 1))[:, None]
    slots: dict[tuple[str, ...], np.ndarray] = {}
    for r, (k, i, size, (path, text, linked)) in enumerate(flat):
        if hide is not None and hide[k]:
            path = tuple(t for t in path if t not in REGIONS)
        if path not in slots:
            slots[path] = np.unique([crc32(f"{len(path) - d if len(path) - d < 4 else 4}{t}".encode()) % TAGS for d, t in enumerate(path)]).astype(np.int64)
        x[r, slots[path]] = 1.0
        x[r, TAGS + WORDS :] = (np.log1p(n[r]) / 4, linked / max(len(text), 1), i / size, (size - i) / size, len(path) / 8, text[-1] in ".!?")
    return x


@dataclass
class Model:
    """Weights of both directions side by side: input, recurrent, bias; and the output layer."""

    wx: np.ndarray  #: 2, inputs, 4 * HIDDEN
    wh: np.ndarray  #: 2, HIDDEN, 4 * HIDDEN
    b: np.ndarray  #: 2, 4 * HIDDEN
    wo: np.ndarray  #: 2 * HIDDEN + 1

    @classmethod
    def new(cls, seed: int = 5) -> Model:
        r, d = np.random.default_rng(seed), TAGS + WORDS + FIGURES
        b = np.zeros((2, 4 * HIDDEN), dtype=np.float32)
        b[:, HIDDEN : 2 * HIDDEN] = 1.0
        f = np.float32
        return cls((r.normal(0, 0.15, (2, d, 4 * HIDDEN))).astype(f), (r.normal(0, 0.15, (2, HIDDEN, 4 * HIDDEN))).astype(f), b, r.normal(0, 0.1, 2 * HIDDEN + 1).astype(f))

    def arrays(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.wo]

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: steps, pages, inputs; mask: steps, pages. Scores, and what training needs."""
        steps, pages, _ = x.shape
        states, tape = np.zeros((steps, pages, 2 * HIDDEN), dtype=np.float32), []
        for d in range(2):
            pre = x @ self.wx[d] + self.b[d]
            h = np.zeros((pages, HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            trace = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = pre[t] + h @ self.wh[d]
                i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[t][:, None]
                new = f * c + i * g
                tc = np.tanh(new)
                trace.append((t, h, c, i, f, o, g, tc, m))
                c = m * new + (1 - m) * c
                h = m * (o * tc) + (1 - m) * h
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
            tape.append(trace)
        return states @ self.wo[:-1] + self.wo[-1], [states, tape]

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """forward() without what training needs; gates in one pass."""
        steps, pages, _ = x.shape
        out = np.full((steps, pages), self.wo[-1], dtype=np.float32)
        for d in range(2):
            pre = (x.reshape(steps * pages, -1) @ self.wx[d] + self.b[d]).reshape(steps, pages, -1)
            h = np.zeros((pages, HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            own = self.wo[d * HIDDEN : (d + 1) * HIDDEN]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = pre[t]
                z += h @ self.wh[d]
                gate = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN])
                new = gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                live = mask[t][:, None]
                c += live * (new - c)
                h += live * (gate[:, 2 * HIDDEN :] * np.tanh(new) - h)
                out[t] += h @ own
        return out

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        score, (states, tape) = self.forward(x, mask)
        err = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * mask / max(mask.sum(), 1)).astype(np.float32)
        out = [np.zeros_like(a) for a in self.arrays()]
        out[3][:-1] = np.einsum("tp,tph->h", err, states)
        out[3][-1] = err.sum()
        up = err[:, :, None] * self.wo[:-1]
        for d in range(2):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tc, m in reversed(tape[d]):
                total = dh + up[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                own, own_c = total * m, dc * m
                dn = own_c + own * o * (1 - tc * tc)
                dz = np.concatenate((dn * g * i * (1 - i), dn * c * f * (1 - f), own * tc * o * (1 - o), dn * i * (1 - g * g)), axis=1)
                dz_all[t] = dz
                out[1][d] += h.T @ dz
                dh = dz @ self.wh[d].T + total * (1 - m)
                dc = dn * f + dc * (1 - m)
            out[0][d] = np.einsum("tpi,tpz->iz", x, dz_all, optimize=True)
            out[2][d] = dz_all.sum(axis=(0, 1))
        return out


def _padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(sizes)
    out = np.zeros((steps, len(sizes), x.shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(sizes)), dtype=np.float32)
    at = 0
    for k, n in enumerate(sizes):
        out[:n, k], mask[:n, k] = x[at : at + n], 1
        at += n
    return out, mask


def made_up(n: int = 60, seed: int = 3) -> list[str]:
    """Pages with regions, of made-up words: what a table without any region is labelled after."""
    rng = np.random.default_rng(seed)
    lexicon = ["".join(rng.choice(list("abdegiklmnoprstuv"), rng.integers(2, 9))) for _ in range(400)]
    say = lambda lo, hi: " ".join(lexicon[i] for i in rng.integers(0, 400, rng.integers(lo, hi)))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(rng.integers(3, 9))) + "</ul>"
    body = lambda: "".join(f"<h2>{say(2, 5)}</h2>" if rng.random() < 0.2 else f"<p>{say(12, 60)}. {say(8, 30)}.</p>" for _ in range(rng.integers(2, 12)))
    return [
        f"<html><body><header><p>{say(1, 4)}</p></header><nav>{menu()}</nav><div><main><h1>{say(3, 7)}</h1>{body()}</main>"
        f'<aside>{menu()}</aside><div class="ad"><p>{say(2, 6)}</p></div></div><footer><p>{say(2, 8)}</p>{menu()}</footer></body></html>'
        for _ in range(n)
    ]


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Adam over the pages' sequences of blocks; pages without regions teach nothing."""
    model = Model.new()
    taught = [own for p in pages if (own := blocks(p)) and any(t in REGIONS for path, *_ in own for t in path)]
    if not taught:
        taught = [blocks(p) for p in made_up()]
    rng, moment, square, step = np.random.default_rng(11), [np.zeros_like(a) for a in model.arrays()], [np.zeros_like(a) for a in model.arrays()], 0
    # (page, first block): what is learnt from at once
    parts = sorted(((k, at) for k, p in enumerate(taught) for at in range(0, len(p), SEQUENCE)), key=lambda x: min(SEQUENCE, len(taught[x[0]]) - x[1]))
    groups = [parts[i : i + 16] for i in range(0, len(parts), 16)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            group = groups[g]
            own = [taught[k][at : at + SEQUENCE] for k, at in group]
            sizes = [len(p) for p in own]
            x, mask = _padded(features(own, rng.random(len(group)) < 0.5, [(at, len(taught[k])) for k, at in group]), sizes)
            y = np.zeros_like(mask)
            for j, p in enumerate(own):
                y[: len(p), j] = [label(path) for path, *_ in p]
            step += 1
            for a, d, m, v in zip(model.arrays(), model.gradient(x, mask, y), moment, square, strict=True):
                m += 0.1 * (np.clip(d, -1, 1) - m)
                v += 0.001 * (np.clip(d, -1, 1) ** 2 - v)
                a -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def classify(model: Model, parsed: list[list]) -> list[np.ndarray]:
    """Whether each block of each page is content."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(parsed)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        stop, longest = at, 0
        while stop < len(order) and stop - at < 256 and (stop == at or (stop - at + 1) * len(parsed[order[stop]]) <= 8192):
            stop += 1
        group = order[at:stop]
        longest = [len(parsed[k]) for k in group]
        x, mask = _padded(features([parsed[k] for k in group]), longest)
        score = model.scores(x, mask)
        for j, k in enumerate(group):
            out[k] = score[: longest[j], j] > 0
        at = stop
    return out


def regioned(page: str) -> bool:
    """Whether some block of the page lies under a region tag."""
    return any(t in REGIONS for path, *_ in blocks(page) for t in path)


def sample(pages: DataFrame) -> list[str]:
    """The FIT_PAGES pages with the lowest hash among those that have regions. Which they are is told
    by hashes; pages themselves come to the driver once that is known.
    """
    # every page with regions has such a tag; that blocks lie under it is told by parsing
    maybe = pages.where(F.col("html").rlike(r"(?i)<(article|main|nav|footer|aside|header)|class\s*="))
    keyed = maybe.select("html", F.xxhash64("page_id").alias("h"), F.md5("html").alias("m"))

    def fetched(slim: DataFrame) -> list[str]:
        few = [(r["h"], r["m"]) for r in slim.select("h", "m").distinct().orderBy("h", "m").limit(FIT_PAGES).collect()]
        if not few:
            return []
        one = keyed.where(F.col("h").isin([h for h, _ in few])).where(F.col("m").isin([m for _, m in few])).groupBy("h", "m").agg(F.min("html").alias("html"))
        got = {(r["h"], r["m"]): r["html"] for r in one.collect()}
        return [got[k] for k in few]

    rows = fetched(keyed)
    if len(rows) < FIT_PAGES or all(map(regioned, rows)):
        return [p for p in rows if regioned(p)]

    def keep(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            yield batch.filter(pa.array([regioned(p) for p in batch.column(0).to_pylist()], pa.bool_())).select(["h", "m"])

    batches(pages.sparkSession)
    return fetched(keyed.mapInArrow(keep, "h long, m string"))


SCHEMA = "page_id long, text string, n_blocks int, n_content int"


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, text (content blocks, one a line), n_blocks and n_content, a row for each row of pages."""
    spark = pages.sparkSession
    batches(spark)
    shared = share(spark, model or fit(sample(pages)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in portions(batch, 1, 2 * CHARS):
                parsed = [blocks(h or "") for h in part.column(1).to_pylist()]
                keep = classify(shared.value, parsed)
                text = ["\n".join(b[1] for b, k in zip(p, ks, strict=True) if k) for p, ks in zip(parsed, keep, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(text, pa.string()), pa.array([len(p) for p in parsed], pa.int32()), pa.array([int(k.sum()) for k in keep], pa.int32())], names=["page_id", "text", "n_blocks", "n_content"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)
