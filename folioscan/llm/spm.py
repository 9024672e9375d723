"""SentencePiece encoding and decoding (3): a batched numpy Viterbi.

The text's spaces become U+2581 and it is cut into units that no piece crosses: at
a run of U+2581, at a character without a piece, and between two characters that
stand side by side in no piece. Equal units are encoded once. Units of equal length
advance together: at each end position every substring of at most the longest
piece's length is hashed and looked up in the sorted piece hashes, and a maximum
over the pieces found gives the backpointer. A long unit that few others equal in
length advances alone: all its substrings are looked up at once, and the maxima
are taken from place to place.

The score depends on the model's type, so that the ids are those of the public
SentencePiece library:
 - unigram: the sum of the piece scores, highest wins, of equal ones the longest piece;
 - BPE: summed scores would give other segmentations than the merges do. Here a
   piece scores 0 if merging its text together with that of the piece before it
   gives back just these two (undoing merges shows it), and minus infinity
   otherwise. Exactly one piece passes for each prefix. Pieces that their own text
   doesn't merge to are left out.
Characters without a piece become byte pieces, or one unknown piece a run of them
where the model has no byte pieces.

Memory: about CHARS characters are worked on at a time, whatever the batch holds, a
longer text in parts of PART characters, cut where no piece crosses; units
remembered take a fixed table of SLOTS places.

Models: those that take text as it is and put a space in front of it (a normaliser
other than identity, removal of spaces, user-defined pieces and pieces across
spaces are refused with a ValueError). The model file is read by the driver.

Defined results: a null text has null token_ids, a row of null token_ids decodes to
a null text; an empty text has none; decoding gives back the text, except that
U+2581 itself decodes to a space, as in the library (round_trip is then false).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, CHARS, U64, batches, codepoints, mix, portions, powers, prefix_hash, share, span_hash, spans_of

MODEL = os.environ.get("FOLIOSCAN_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = 0x2581
UNIGRAM, BPE = 1, 2
#: Units that a worker remembers at most, and ids of one (speed only; 11 MB).
SLOTS, WIDE = 1 << 18, 8
#: Units of a length of which there are fewer advance alone if they are longer than ALONE.
FEW, ALONE = 24, 40
#: Characters of one text worked on at a time.
PART = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Tag and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Pieces:
    text: list[str]
    score: np.ndarray
    kind: np.ndarray  #: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    model: int


def read_model(raw: bytes) -> Pieces:
    text, score, kind, model = [], [], [], UNIGRAM
    for tag, value in _fields(raw):
        if tag == 1:
            one = dict(_fields(value))
            text.append(one[1].decode())
            score.append(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
            kind.append(one.get(3, 1))
        elif tag == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif tag == 3:
            spec = dict(_fields(value))
            if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("the model changes its text by more than a space in front")
    if model not in (UNIGRAM, BPE) or 4 in kind:
        raise ValueError("not a unigram or BPE model without user-defined pieces")
    return Pieces(text, np.array(score, dtype=np.float64), np.array(kind), model)


class Codec:
    def __init__(self, pieces: Pieces) -> None:
        self.model = pieces.model
        usable = [i for i, k in enumerate(pieces.kind) if k == 1 and pieces.text[i]]
        self.longest = max(len(pieces.text[i]) for i in usable)
        self.known = np.zeros(0x110000, dtype=bool)
        for i in usable:
            for c in pieces.text[i]:
                self.known[ord(c)] = True
        if any(SPACE in map(ord, pieces.text[i].lstrip(chr(SPACE))) for i in usable):
            raise ValueError("a piece spans words; units can't be cut at spaces")
        # two characters side by side in some piece, as a bit table: a bit too many only cuts less
        self.beside = np.zeros(1 << 22, dtype=bool)
        for i in usable:
            c = codepoints(pieces.text[i])
            self.beside[self._side(c[:-1], c[1:])] = True
        self.bytes = np.zeros(256, dtype=np.int32)
        for i, k in enumerate(pieces.kind):
            if k == 6:
                self.bytes[int(pieces.text[i][3:5], 16)] = i
        self.unknown = int(np.flatnonzero(pieces.kind == 2)[0]) if (pieces.kind == 2).any() else 0
        self.fallback = bool((pieces.kind == 6).any())
        # raw (unmixed) hashes: of the whole piece, read from its own start
        raw = np.array([self._raw(t) for t in (pieces.text[i] for i in usable)], dtype=U64)
        order = np.argsort(raw)
        self.keys, self.ids = raw[order], np.array(usable, dtype=np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 19, dtype=bool)
        self.maybe[(self.keys * U64(0xD6E8FEB86659FD93)) >> U64(64 - 19)] = True
        n = len(pieces.text)
        self.worst = float(pieces.score[usable].min())
        self.score, self.length, self.raw = pieces.score, np.array([len(t) for t in pieces.text]), np.zeros(n, dtype=U64)
        self.raw[usable] = [self._raw(pieces.text[i]) for i in usable]
        self.pow = powers(BASE, 4 * self.longest + 4)
        out = [b""] * n
        for i, k in enumerate(pieces.kind):
            out[i] = bytes([int(pieces.text[i][3:5], 16)]) if k == 6 else pieces.text[i].replace(chr(SPACE), " ").encode() if k == 1 else "⁇".encode() if k == 2 else b""
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_len = np.array([len(b) for b in out])
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.ok = np.ones(n, dtype=bool)
        if self.model == BPE:
            self._merges(pieces, usable)
        self.pair_key = np.full(1 << 21, -1, dtype=np.int64)
        self.pair_ok = np.zeros(1 << 21, dtype=bool)
        self.unit_key = np.zeros(SLOTS, dtype=U64)
        self.unit_n = np.zeros(SLOTS, dtype=np.int8)
        self.unit_ids = np.zeros((SLOTS, WIDE), dtype=np.int32)

    @staticmethod
    def _side(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(U64) << U64(32) | b.astype(U64)) * U64(0xD6E8FEB86659FD93)) >> U64(64 - 22)

    @staticmethod
    def _raw(text: str) -> int:
        return sum((ord(c) + 1) * pow(int(BASE), i, 1 << 64) for i, c in enumerate(text)) % (1 << 64)

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Piece ids of raw hashes, -1 where there is none."""
        at = np.searchsorted(self.keys, raw)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == raw, self.ids[at], -1)

    def _merges(self, pieces: Pieces, usable: list[int]) -> None:
        """How each piece is merged from two: by running the merges on its own text."""
        self.left = np.full(len(pieces.text), -1, dtype=np.int32)
        self.right = self.left.copy()
        of = {pieces.text[i]: i for i in usable}
        for i in usable:
            t = pieces.text[i]
            if len(t) == 1:
                continue
            parts = list(t)
            while len(parts) > 1:
                best, where = None, -1
                for j in range(len(parts) - 1):
                    k = of.get(parts[j] + parts[j + 1])
                    if k is not None and (best is None or self.score[k] > best):
                        best, where = self.score[k], j
                if best is None:
                    break
                if len(parts) == 2:
                    self.left[i], self.right[i] = of.get(parts[0], -1), of.get(parts[1], -1)
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            self.ok[i] = len(parts) == 1 and self.left[i] >= 0 and self.right[i] >= 0

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b gives back a, b."""
        key = a.astype(np.int64) * len(self.score) + b
        slot = (mix(key.view(U64)) & U64(len(self.pair_key) - 1)).astype(np.int64)
        hit = self.pair_key[slot] == key
        out = self.pair_ok[slot]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            fine = self._undo(new // len(self.score), new % len(self.score))
            out[~hit] = fine[back]
            at = slot[~hit]
            self.pair_key[at], self.pair_ok[at] = key[~hit], out[~hit]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both pieces' merges are undone from the last back; the border must never have been
        the best pair: at each moment, a piece that spans it must come after the next merge.

        A merge is before another if its score is higher or, with equal scores, if it is
        further left. Merges of a are left of the border, those of b right of it.
        """
        ok = np.ones(len(a), dtype=bool)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        # next_a: score of the merge that made the current right edge of a last change (what the border must lose to)
        limit = np.full(len(a), -np.inf)
        of_b = np.zeros(len(a), dtype=bool)  # the merge that gave limit was in b: a border merge of equal score is further left and wins
        while len(live):
            x, y = a[live], b[live]
            span = self.find(self.raw[x] + self.raw[y] * self.pow[self.length[x]])
            got = np.where(span >= 0, self.score[np.maximum(span, 0)], -np.inf)
            bad = (span >= 0) & ((got > limit[live]) | (got == limit[live]) & of_b[live])
            ok[live[bad]] = False
            sx = np.where(self.length[x] > 1, self.score[x], np.inf)
            sy = np.where(self.length[y] > 1, self.score[y], np.inf)
            # the later of the two last merges is undone: the lower score; of equal ones b's, being further right
            back_b = sy <= sx
            done = bad | (np.isinf(sx) & np.isinf(sy))
            go = live[~done]
            back_b = back_b[~done]
            limit[go] = np.where(back_b, sy[~done], sx[~done])
            of_b[go] = back_b
            a[go[~back_b]] = self.right[a[go[~back_b]]]
            b[go[back_b]] = self.left[b[go[back_b]]]
            live = go
        return ok

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, unit starts and ends, and units by text."""
        sp = chr(SPACE)
        full = [sp + t.replace(" ", sp) if t else "" for t in texts]
        codes = codepoints("".join(full))
        sizes = np.array([len(t) for t in full])
        ends = np.cumsum(sizes)
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[np.concatenate(([0], ends))] = True
        if len(codes):
            first[1:-1] |= self.borders(codes)
        at = np.flatnonzero(first)
        start, end = at[:-1], at[1:]
        by = np.searchsorted(start, np.concatenate(([0], ends)))
        return codes, start, end, np.diff(by)

    def borders(self, codes: np.ndarray) -> np.ndarray:
        """Whether a unit ends between each character and the next."""
        space, lone = codes == SPACE, ~self.known[codes]
        return lone[:-1] | lone[1:] | space[1:] & ~space[:-1] | ~self.beside[self._side(codes[:-1], codes[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text."""
        ids, counts = [], []
        for a, b in spans_of(texts):
            i, n = self._long(texts[a]) if len(texts[a]) > CHARS else self._short(texts[a:b])
            ids.append(i)
            counts.append(n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """One text, in parts cut where a unit ends; a unit of over PART characters stays whole."""
        out, at, size = [], 0, PART
        while at < len(text):
            codes = codepoints((chr(SPACE) if not at else "") + text[at : at + size].replace(" ", chr(SPACE)))
            last = at + size >= len(text)
            stop = len(codes)
            if not last:
                cut = np.flatnonzero(self.borders(codes))
                if not len(cut):
                    size *= 2
                    continue
                stop = int(cut[-1]) + 1
            first = np.concatenate(([True], self.borders(codes[:stop]), [True]))
            edge = np.flatnonzero(first)
            out.append(self._ids(codes[:stop], edge[:-1], edge[1:])[0])
            at, size = at + stop - (not at), PART
        got = np.concatenate(out)
        return self._runs(got, np.array([len(got)]))

    def _short(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, start, end, per = self.units(texts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), dtype=np.int64)
        ids, n = self._ids(codes, start, end)
        upto = np.concatenate(([0], np.cumsum(n)))
        edge = np.concatenate(([0], np.cumsum(per)))
        return self._runs(ids, upto[edge[1:]] - upto[edge[:-1]])

    def _runs(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without byte pieces, unknown characters in a row are one piece."""
        if self.fallback or not len(ids):
            return ids, counts
        again = np.concatenate(([False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)))
        begin = np.cumsum(counts) - counts
        again[begin[counts > 0]] = False
        left = np.concatenate(([0], np.cumsum(~again)))
        return ids[~again], left[begin + counts] - left[begin]

    def _ids(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        key, at, back = np.unique(span_hash(prefix_hash(codes), start, end), return_index=True, return_inverse=True)
        slot = (key >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        held = (self.unit_key[slot] == key) & (self.unit_n[slot] > 0)
        sizes, old, new = np.zeros(len(key), dtype=np.int64), np.flatnonzero(held), np.flatnonzero(~held)
        sizes[old] = self.unit_n[slot[old]]
        if len(new):
            own, flat, n = self._learn(codes, start[at[new]], end[at[new]])
            new = new[own]
            sizes[new] = n
        begin = np.cumsum(sizes) - sizes
        every = np.empty(int(sizes.sum()), dtype=np.int32)
        wide = np.arange(WIDE)
        inside = wide < sizes[old][:, None]
        every[(begin[old][:, None] + wide)[inside]] = self.unit_ids[slot[old]][inside]
        if len(new):
            src = np.cumsum(n) - n
            every[np.repeat(begin[new] - src, n) + np.arange(len(flat))] = flat
            # kept for later; of two units with one slot the last stays, whole
            few = np.flatnonzero((n > 0) & (n <= WIDE))
            _, last = np.unique(slot[new[few]][::-1], return_index=True)
            few = few[len(few) - 1 - last]
            place, inside = slot[new[few]], wide < n[few][:, None]
            rows = np.zeros((len(few), WIDE), dtype=np.int32)
            rows[inside] = flat[(src[few][:, None] + wide)[inside]]
            self.unit_key[place], self.unit_n[place], self.unit_ids[place] = key[new[few]], n[few], rows
        n = sizes[back]
        total = np.cumsum(n)
        return every[np.repeat(begin[back] - (total - n), n) + np.arange(total[-1])], n

    def _learn(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units in the order in which they were done, their ids in a row, and how many each has."""
        size = end - start
        order, ids, counts = [], [], []
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            if length > ALONE and len(rows) < FEW:
                got = [self._alone(codes[start[r] : end[r]]) for r in rows.tolist()]
                order.append(rows)
                ids += got
                counts.append(np.array([len(g) for g in got]))
                continue
            step = max(1, 500_000 // (length + 1))
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                flat, n = self._viterbi(codes, start[own], int(length))
                order.append(own)
                ids.append(flat)
                counts.append(n)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _alone(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one unit of any length: every substring is probed in one go for each size, then maxima from place to place."""
        n = len(codes)
        values = codes.astype(U64) + U64(1)
        raw, ends, sizes, found = np.zeros(n + 1, dtype=U64), [], [], []
        for size in range(1, min(n, self.longest) + 1):
            raw = values[: n - size + 1] + raw[1:] * BASE if size > 1 else values
            rows, piece = self._probe(raw)
            fine = self.ok[piece]
            ends.append(rows[fine] + size)
            sizes.append(np.full(int(fine.sum()), size))
            found.append(piece[fine])
        end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)
        order = np.lexsort((-size, end))
        first = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        size, piece = size[order].tolist(), piece[order].tolist()
        bpe, score = self.model == BPE, self.score
        best, last, told = [0.0] * (n + 1), [-1] * (n + 1), {}
        for stop in range(1, n + 1):
            lo, hi = first[stop], first[stop + 1]
            single = hi > lo and size[hi - 1] == 1
            top, take = (-np.inf if bpe or single else best[stop - 1] + self.worst - 10.0), -1
            for k in range(lo, hi):
                p, back = piece[k], stop - size[k]
                if not bpe:
                    value = best[back] + score[p]
                    if value > top:
                        top, take = value, p
                elif not back:
                    top, take = 0.0, p
                elif (b := last[back]) >= 0:
                    if (b, p) not in told:
                        told[b, p] = bool(self.may_follow(np.array([b]), np.array([p]))[0])
                    if told[b, p]:
                        top, take = 0.0, p
            best[stop], last[stop] = top, take
        out, at = [], n
        while at:
            p = last[at]
            out += [p] if p >= 0 else self._fallback(chr(codes[at - 1]))[::-1]
            at -= int(self.length[p]) if p >= 0 else 1
        return np.array(out[::-1], dtype=np.int32)

    def _viterbi(self, codes: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        chars = codes[start[:, None] + np.arange(length)[None, :]]
        n = len(start)
        last = np.full((length + 1, n), -1, dtype=np.int32)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        values = np.ascontiguousarray(chars.T).astype(U64) + U64(1)
        gain = self._gain_bpe if self.model == BPE else self._gain_unigram
        for stop in range(1, length + 1):
            self._step(values, last, best, stop, gain)
        out = np.full((n, length), -2, dtype=np.int32)
        at = np.full(n, length)
        live = np.arange(n)
        bare = False
        while len(live):
            piece = last[at[live], live]
            out[live, at[live] - 1] = piece
            bare |= bool((piece < 0).any())
            at[live] -= np.where(piece >= 0, self.length[piece], 1)
            live = live[at[live] > 0]
        if not bare:
            used = out >= 0
            return out[used], used.sum(axis=1)
        # characters that no piece covers here become bytes
        rows = [[x for p, c in zip(o, t, strict=True) if p != -2 for x in ((p,) if p >= 0 else self._fallback(chr(c)))] for o, t in zip(out.tolist(), chars.tolist(), strict=True)]
        return np.array([x for r in rows for x in r], dtype=np.int32), np.array([len(r) for r in rows])

    def _step(self, values: np.ndarray, last: np.ndarray, best: np.ndarray, stop: int, gain) -> None:
        """Every substring that ends here probes; the best of the pieces found is stored, of equal ones the longest."""
        raw, tried = None, []
        for n in range(1, min(stop, self.longest) + 1):
            raw = values[stop - n] if raw is None else values[stop - n] + raw * BASE
            rows, piece = self._probe(raw)
            fine = self.ok[piece]
            rows, piece = rows[fine], piece[fine]
            if len(rows):
                tried.append((rows, piece, gain(best[stop - n, rows], last[stop - n, rows], piece, stop > n)))
        top = np.full(best.shape[1], -np.inf)
        for rows, _, value in tried:
            top[rows] = np.maximum(top[rows], value)
        for rows, piece, value in tried:
            reached = (value == top[rows]) & (value > -np.inf)
            last[stop, rows[reached]] = piece[reached]
        # a character that no piece ends with costs ten more than the worst piece
        best[stop] = top
        if self.model == UNIGRAM:
            bare = best[stop - 1] + self.worst - 10.0
            one = tried[0][0] if tried and self.length[tried[0][1][0]] == 1 else np.zeros(0, np.int64)
            allowed = np.ones(len(bare), dtype=bool)
            allowed[one] = False
            use = allowed & (bare > top)
            best[stop, use], last[stop, use] = bare[use], -1

    def _gain_bpe(self, best: np.ndarray, last: np.ndarray, piece: np.ndarray, inner: bool) -> np.ndarray:
        out = np.zeros(len(piece))
        if inner:
            out[last < 0] = -np.inf
            known = np.flatnonzero(last >= 0)
            out[known[~self.may_follow(last[known], piece[known])]] = -np.inf
        return out

    def _gain_unigram(self, best: np.ndarray, last: np.ndarray, piece: np.ndarray, inner: bool) -> np.ndarray:
        return best + self.score[piece]

    def _probe(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces; a table of bits keeps most others from the search."""
        rows = np.flatnonzero(self.maybe[(raw * U64(0xD6E8FEB86659FD93)) >> U64(64 - 19)])
        piece = self.find(raw[rows])
        return rows[piece >= 0], piece[piece >= 0]

    def _fallback(self, char: str) -> tuple[int, ...]:
        return tuple(int(self.bytes[b]) for b in char.encode("utf-8", "surrogatepass")) if self.fallback else (self.unknown,)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        n = self.out_len[ids]
        total = np.concatenate(([0], np.cumsum(n)))
        raw = self.out[np.repeat(self.out_at[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        edge = total[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_CODEC: dict[bytes, Codec] = {}


def codec(raw: bytes | None = None) -> Codec:
    """The codec of a model file's bytes; a worker holds one at a time."""
    raw = model_bytes() if raw is None else raw
    name = md5(raw).digest()
    if name not in _CODEC:
        _CODEC.clear()
        _CODEC[name] = Codec(read_model(raw))
    return _CODEC[name]


SCHEMA = "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean"


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip (decoding gave the text back), a row for each row of docs."""
    batches(docs.sparkSession)
    shared = share(docs.sparkSession, model_bytes(path))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in rows:
            for part in portions(batch):
                given = part.column(1).to_pylist()
                own = [t or "" for t in given]
                ids, counts = c.encode(own)
                same = [x == y for x, y in zip(c.decode(ids, counts), own, strict=True)]
                null = np.array([t is None for t in given], dtype=bool)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(np.array(same), mask=null)], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids."""
    batches(tokens.sparkSession)
    shared = share(tokens.sparkSession, model_bytes(path))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in rows:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()]
            got = c.decode(np.concatenate(lists), np.array([len(x) for x in lists], dtype=np.int64)) if lists else []
            yield pa.record_batch([batch.column(0), pa.array([None if n else t for n, t in zip(batch.column(1).is_null().to_pylist(), got, strict=True)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")
