"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled once, on the driver, into arrays of integers (:class:`Tables`); these machines are composed with each input:

* the normaliser maps a space to the sign for it and puts one in front of a text;
* the piece machine has a state for each beginning of a piece; from every place of the input all its arcs are followed at once, which gives the
  arcs (from, to, piece) of the composition, at the cost -score in a unigram model and 0 in a pair-merging one. A character that is no piece
  has an arc of its own, which byte fallback writes as the pieces of its bytes;
* in a pair-merging model the pair machine remembers the last piece. Merging by rank yields the only segmentation in which merging any two
  neighbours' text anew gives these two pieces again, so an arc behind a piece costs 0 if it does and infinity if it does not
  (:meth:`Machine.allowed` decides this on the tables of merges).

The answer is the shortest path in the tropical semiring: arcs are relaxed from the left, costs add up along a path, and the least
stays. As one path into a place at most has a finite cost where pairs are constrained, the last piece is a function of the place. No arc crosses from a character
into a space sign, nor over a character that no piece has, so a text is cut there into stretches; each different one of a batch is composed
once, all of them together, and a bounded number (KEPT) of results is kept for later batches.

The vocabulary file is read by the driver from a path that the caller gives; the tables, of a size that the vocabulary fixes, are broadcast. Defined results:
null and empty texts have no ids and decode to an empty text. Ids outside the vocabulary raise an error when decoded. Repeated rows are encoded alike; empty
tables give empty ones; only doc_id and text are read. A stretch takes a step of all arrays for each of its characters, so one of a million characters without a
space takes about a minute.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import pieces

SPACE = "▁"
UNIGRAM, PAIRS = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches whose ids a machine keeps.
KEPT = 1_000_000
#: Bytes of text that are encoded at a time: a stretch that stands in them twice is composed once.
ENCODED_BYTES = 2 << 20
#: Cost of a character without a piece in a unigram model, above the dearest piece.
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class Model:
    """What the machines are compiled from."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    prefix: bool
    squeeze: bool


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, raw[at : at + n]
            at += n
        elif wire == 5:
            yield number, struct.unpack("<f", raw[at : at + 4])[0]
            at += 4
        else:
            yield number, raw[at : at + 8]
            at += 8


def load(path: str) -> Model:
    """The model in a file, read on the driver."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(raw: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            x = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            pieces.append((x[1].decode(), x[2], x[3]))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, PAIRS) or normalizer.get(2):
        raise ValueError("only unigram and pair-merging models with the identity normaliser are compiled")
    return Model(tuple(pieces), kind, bool(trainer.get(35, 0)), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


@dataclass(frozen=True)
class Lookup:
    """A table from non-negative 64-bit keys to numbers, asked for many keys at once (linear probing)."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, found: dict[int, int]) -> Lookup:
        size = 1 << max(4, (2 * len(found)).bit_length())
        keys, values = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        todo = np.fromiter(found, dtype=np.int64, count=len(found))
        value = np.fromiter(found.values(), dtype=np.int32, count=len(found))
        slot = cls._slot(todo, size)
        while len(todo):
            free = np.flatnonzero(keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            keys[slot[placed]], values[slot[placed]] = todo[placed], value[placed]
            rest = np.setdiff1d(np.arange(len(todo)), placed, assume_unique=True)
            todo, value, slot = todo[rest], value[rest], (slot[rest] + 1) & (size - 1)
        return cls(keys, values)

    @staticmethod
    def _slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys, len(self.keys))
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slot[more] = at = (slot[more] + 1) & (len(self.keys) - 1)
            there, wanted = self.keys[at], keys[more]
            hit = there == wanted
            out[more[hit]] = self.values[at[hit]]
            more = more[~hit & (there >= 0)]
        return out


@dataclass(frozen=True)
class Tables:
    """The compiled machines as arrays of integers.

    Symbols 0..n-1 are the pieces, in order of the vocabulary; those from n on are characters that occur in pieces and are none themselves.
    ``arcs`` leads from state * (letters + 1) + letter to the next state of the piece machine, ``accepts`` has the symbol that ends in a state (or -1),
    ``cost`` the weight of each symbol's arc. For the pair constraint, ``joint`` has the merge rank of two symbols put together, ``rank`` that of
    each symbol (-1: a character, never merged), and ``left`` and ``right`` the two that merging joined last. ``odd`` marks symbols whose merges do not come in order of
    rank; pairs with them are merged anew. Symbol i is written as the ids out_ids[out_first[i]:out_first[i + 1]], and piece i spelled as written[i].
    """

    kind: int
    prefix: bool
    squeeze: bool
    letters: dict[str, int]
    arcs: Lookup
    accepts: np.ndarray
    cost: np.ndarray
    joint: Lookup
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    odd: np.ndarray
    texts: tuple[str, ...]
    out_first: np.ndarray
    out_ids: np.ndarray
    written: tuple[str, ...]
    by_byte: dict[int, int]
    unknown: int
    byte_fallback: bool
    apart: bool


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], int]:
    """Pieces by merging (the neighbours whose joint piece scores highest first, the leftmost of equals), and where the last merge joined its two."""
    parts, none, seam = list(text), -np.inf, 0
    get = scores.get
    open_ = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while open_ and (best := max(open_)) > none:
        i = open_.index(best)
        seam = len(parts[i])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del open_[i]
        if i:
            open_[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(open_):
            open_[i] = get(parts[i] + parts[i + 1], none)
    return parts, seam


def compiled(model: Model) -> Tables:
    """All machines of a model. Takes about a second for 32,000 pieces, once in a driver."""
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) and p}
    scores = {p: model.pieces[i][1] for p, i in usable.items()}
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    by_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
    letters = {c: k for k, c in enumerate(sorted({c for p in usable for c in p}), 1)}
    bare = [c for c in letters if c not in usable]
    symbol = usable | {c: len(model.pieces) + k for k, c in enumerate(bare)}
    count = len(model.pieces) + len(bare)

    # Piece machine.
    states, arcs, accepts = {"": 0}, {}, [-1]
    width = len(letters) + 1
    for text, at in symbol.items():
        state = 0
        for k in range(1, len(text) + 1):
            part = text[:k]
            if part not in states:
                states[part] = len(accepts)
                arcs[state * width + letters[text[k - 1]]] = len(accepts)
                accepts.append(-1)
            state = states[part]
        accepts[state] = at
    cost = np.zeros(count)
    if model.kind == UNIGRAM:
        for p, i in usable.items():
            cost[i] = -scores[p]
        cost[len(model.pieces) :] = UNKNOWN_COST - min(scores.values(), default=0.0)

    # Pair constraint.
    rank, left, right, odd, joint = np.full(count, -1, dtype=np.int32), np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int32), np.zeros(count, dtype=bool), {}
    if model.kind == PAIRS:
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        for p, i in usable.items():
            if len(p) > 1:
                rank[i] = order[scores[p]]
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    joint[a * count + b] = int(rank[i])
            if len(p) > 1:
                parts, seam = merged(p, scores)
                if len(parts) > 1:
                    accepts[states[p]] = -1  # merging never makes this piece
                    odd[i] = True
                    continue
                left[i], right[i] = symbol[p[:seam]], symbol[p[seam:]]
                odd[i] = not (rank[i] > rank[left[i]] and rank[i] > rank[right[i]])
        for p in sorted(usable, key=len):  # a symbol made of odd ones is odd
            i = usable[p]
            odd[i] |= len(p) > 1 and bool(odd[left[i]] or odd[right[i]])

    texts = [p for p, _, _ in model.pieces] + bare
    outputs = [(i,) for i in range(len(model.pieces))] + [tuple(by_byte[b] for b in c.encode()) if model.byte_fallback else (unknown,) for c in bare]
    out_first = np.concatenate([[0], np.cumsum([len(x) for x in outputs])]).astype(np.int64)
    apart = all(SPACE not in p.lstrip(SPACE) for p in usable)
    written = ["" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else p.replace(SPACE, " ") for p, _, kind in model.pieces]
    return Tables(
        model.kind, model.prefix, model.squeeze, letters, Lookup.of(arcs), np.array(accepts, dtype=np.int32), cost, Lookup.of(joint), rank, left, right, odd,
        tuple(texts), out_first, np.array(list(chain.from_iterable(outputs)), dtype=np.int32), tuple(written), by_byte, unknown, model.byte_fallback, apart,
    )


def _bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins and ends."""
    raw, n = texts.buffers()[2], len(texts)
    if not n or raw is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _points(byte: np.ndarray) -> np.ndarray:
    """Code points of UTF-8."""
    return np.frombuffer(str(memoryview(byte), "utf-8").encode("utf-32-le"), dtype=np.uint32)


class Machine:
    """Composition with inputs, and the shortest path."""

    def __init__(self, tables: Tables | Model):
        self.t = compiled(tables) if isinstance(tables, Model) else tables
        self.scores = {self.t.texts[i]: -int(r) for i, r in enumerate(self.t.rank) if r >= 0}
        # Number of the letter at each code point.
        self.letter = np.zeros(max(map(ord, self.t.letters), default=0) + 2, dtype=np.int32)
        self.letter[list(map(ord, self.t.letters))] = list(self.t.letters.values())
        self.byte_of = {i: b for b, i in self.t.by_byte.items()}
        self.spelled = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else x.encode() for i, x in enumerate(self.t.written)], pa.binary())
        self._clear()

    def _clear(self) -> None:
        """Forget the results kept: the k-th known stretch has the ids kept[first[k]:first[k + 1]]."""
        self.known = pa.array([], pa.large_string())
        self.kept, self.first = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def normalise(self, texts: pa.Array) -> pa.LargeStringArray:
        """The normaliser: spaces become signs, and a text that is not empty gets one in front; some models squeeze runs of spaces first."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.t.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        signed = pc.replace_substring(texts, " ", SPACE)
        if self.t.prefix:
            none, sign = pa.scalar("", pa.large_string()), pa.scalar(SPACE, pa.large_string())
            signed = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(sign, signed, none))
        return pc.utf8_rtrim(signed, SPACE) if self.t.squeeze else signed

    def _letters(self, point: np.ndarray) -> np.ndarray:
        """The number of the letter of each code point, 0 if no piece has it."""
        return np.where(point < len(self.letter), self.letter[np.minimum(point, len(self.letter) - 1)], 0)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether symbols may stand side by side: merging their joint text gives the two again.

        Merges are undone from the last one back. What touches across the seam at any time would have been joined if its rank were
        below that of the merge undone (or equal, where that merge is the right one: of equals the leftmost goes first).
        """
        t = self.t
        ok = np.ones(len(a), dtype=bool)
        unusual = np.flatnonzero(t.odd[a] | t.odd[b])
        for i in unusual.tolist():
            x, y = t.texts[a[i]], t.texts[b[i]]
            ok[i] = merged(x + y, self.scores)[0] == [x, y]
        at = np.arange(len(a)) if not len(unusual) else np.flatnonzero(~(t.odd[a] | t.odd[b]))
        a, b = a[at].astype(np.int64), b[at].astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int32).max, dtype=np.int64)
        while len(at):
            joint = t.joint(a * len(t.rank) + b)
            bad = (joint >= 0) & (joint < limit)
            ok[at[bad]] = False
            ra, rb = t.rank[a], t.rank[b]
            go = np.flatnonzero(~bad & ((ra >= 0) | (rb >= 0)))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, t.right[a], a), np.where(first, b, t.left[b])
        return ok

    def compose(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from, to, symbol) of the piece machine over letters; a 0 is between stretches and has none."""
        t, width = self.t, len(self.t.letters) + 1
        at = np.flatnonzero(code).astype(np.int32)
        state, depth, found = np.zeros(len(at), dtype=np.int64), 0, []
        while len(at):
            letter = code[at + depth]
            state = t.arcs(state * width + letter).astype(np.int64)
            go = np.flatnonzero((letter > 0) & (state >= 0))
            at, state, depth = at[go], state[go], depth + 1
            symbol = t.accepts[state]
            hit = np.flatnonzero(symbol >= 0)
            found.append((at[hit], at[hit] + np.int32(depth), symbol[hit]))
        if not found:
            return (np.zeros(0, dtype=np.int32),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def shortest(self, stretches: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): stretch k has ids[first[k]:first[k + 1]]. All are relaxed together, from the left; of equally cheap paths the first found stays."""
        t, n = self.t, len(stretches)
        size = pc.utf8_length(stretches).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        code = np.zeros(start[-1] + 1, dtype=np.int32)
        code[np.arange(size.sum()) + np.repeat(np.arange(n), size)] = self._letters(_points(_bytes(stretches)[0]))
        frm, to, symbol = self.compose(code)
        offset = (np.arange(start[-1] + 1) - np.repeat(start, np.append(size + 1, 1)))[frm]
        # Short numbers are sorted digit by digit.
        order = np.argsort(offset.astype(np.uint16) if n and size.max() < 1 << 16 else offset, kind="stable")
        frm, to, symbol, offset = frm[order], to[order], symbol[order], offset[order]
        cost, last = np.full(start[-1] + 1, np.inf), np.full(start[-1] + 1, -1, dtype=np.int32)
        cost[start[:-1]] = 0.0
        steps = [*np.flatnonzero(np.diff(offset, prepend=-1)).tolist(), len(offset)]
        for a, b in pairwise(steps):
            f, e, s = frm[a:b], to[a:b], symbol[a:b]
            total = cost[f] + t.cost[s]
            go = np.flatnonzero(total < cost[e])
            f, e, s, total = f[go], e[go], s[go], total[go]
            if t.kind == PAIRS:
                before = last[f]
                pair = np.flatnonzero(before >= 0)
                ok = np.ones(len(f), dtype=bool)
                ok[pair] = self.allowed(before[pair], s[pair])
                f, e, s, total = f[ok], e[ok], s[ok], total[ok]
            cost[e], last[e] = total, s
        # Back along the paths, all stretches a symbol at a time.
        lengths = np.array([len(x) for x in t.texts], dtype=np.int64)
        which, end, found = np.arange(n), start[:-1] + size, []
        go = np.flatnonzero(size > 0)
        which, end = which[go], end[go]
        while len(which):
            s = last[end]
            found.append((which, end, s))
            end = end - np.where(s >= 0, lengths[s], size[which])
            go = np.flatnonzero(end > start[which])
            which, end = which[go], end[go]
        if not found:
            return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
        which, end, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        which, s = which[order], s[order]
        lone = np.flatnonzero(s < 0)  # characters that no piece has: byte fallback, or unknown
        sizes = np.where(s >= 0, t.out_first[s + 1] - t.out_first[s], 0)
        own = [self._fallback(x) for x in stretches.take(pa.array(which[lone])).to_pylist()]
        sizes[lone] = [len(x) for x in own]
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(first[-1], dtype=np.int32)
        for j in range(int(sizes.max())):
            has = np.flatnonzero((sizes > j) & (s >= 0))
            ids[first[has] + j] = t.out_ids[t.out_first[s[has]] + j]
        for i, x in zip(lone.tolist(), own, strict=True):
            ids[first[i] : first[i] + len(x)] = x
        per = np.bincount(which, sizes, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _fallback(self, text: str) -> tuple[int, ...]:
        return tuple(self.t.by_byte[b] for b in text.encode()) if self.t.byte_fallback else (self.t.unknown,)

    def stretches(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """(stretches, first): normalised text i is stretches[first[i]:first[i + 1]], put together.

        A cut is where no piece reaches over: beside a character that no piece has, and before a space sign unless pieces hold one inside.
        """
        byte, offsets = _bytes(self.normalise(texts))
        point = _points(byte)
        at = np.append(np.flatnonzero((byte & 0xC0) != 0x80), len(byte))
        lone, sign = self._letters(point) == 0, point == ord(SPACE)
        cut = np.zeros(len(point) + 1, dtype=bool)
        cut[np.searchsorted(at, offsets)] = True
        cut[:-1] |= lone
        cut[1:] |= lone
        if self.t.apart:
            cut[:-1] |= sign & ~np.concatenate([[False], sign[:-1]])
        bounds = at[np.flatnonzero(cut)]
        parts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(byte))
        return parts, np.searchsorted(bounds, offsets)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has ids[first[i]:first[i + 1]]. Each different stretch is composed once."""
        parts, text_first = self.stretches(texts)
        parts = parts.dictionary_encode()
        kinds = parts.dictionary
        if len(self.known) > KEPT:
            self._clear()
        place = pc.fill_null(pc.index_in(kinds, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            new = kinds.take(pa.array(unseen))
            place[unseen] = len(self.known) + np.arange(len(unseen))
            ids, first = self.shortest(new)
            self.kept, self.first = np.concatenate([self.kept, ids]), np.concatenate([self.first, self.first[-1] + first[1:]])
            self.known = pa.concat_arrays([self.known, new])
        at = place[parts.indices.to_numpy()]
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        ids = self.kept[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.concatenate([[0], ends])[text_first]
        if not self.t.byte_fallback:  # characters without a piece that stand in a row are one unknown id
            again = np.zeros(len(ids) + 1, dtype=np.int64)
            again[1:-1] = (ids[1:] == self.t.unknown) & (ids[:-1] == self.t.unknown)
            again[first] = 0
            ids, first = ids[again[:-1] == 0], first - np.cumsum(again)[first]
        return ids, first

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of ids[first[i]:first[i + 1]]. Where bytes make no UTF-8 a text is decoded by itself."""
        spelled = pa.ListArray.from_arrays(pa.array(first, pa.int32()), self.spelled.take(pa.array(ids, pa.int32())))
        out = []
        for i, whole in enumerate(pc.binary_join(spelled, b"").to_pylist()):
            try:
                text = whole.decode()
            except UnicodeDecodeError:
                out.append(self.decode(ids[first[i] : first[i + 1]].tolist()))
                continue
            out.append(text[1:] if self.t.prefix and text.startswith(" ") else text)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        ids = list(ids)
        written, byte_of = self.t.written, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            whole = "".join(map(written.__getitem__, ids))
            return whole[1:] if self.t.prefix and whole.startswith(" ") else whole
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(written[i])
        if raw:
            out.append(_utf8(bytes(raw)))
        whole = "".join(out)
        return whole[1:] if self.t.prefix and whole.startswith(" ") else whole


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_machines: dict[str, Machine] = {}
_tables: dict[str, Tables] = {}


def _machine(tables, key: str) -> Machine:
    """The machine of broadcast tables, one in each Python worker."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(tables.value)
    return _machines[key]


def _shared(spark: SparkSession, model: Model):
    """(broadcast of the compiled tables, a name for them). Their size follows from the vocabulary: about 10 MB for 32,000 pieces."""
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = compiled(model)
    return spark.sparkContext.broadcast(_tables[key]), key


def _encode(tables, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(tables, key)
        for batch in batches:
            for part in pieces(batch, limit=ENCODED_BYTES):
                texts = part.column(1)
                ids, first = m.encode_all(texts)
                back = m.decode_all(ids, first)
                decoded = pa.array(back, pa.string())
                sha = [hashlib.sha256(b.encode()).hexdigest() for b in back]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first)), lists, decoded, pa.array(sha, pa.string()), pc.equal(decoded, pc.fill_null(texts, ""))],
                    names=["doc_id", "n_ids", "ids", "decoded", "decoded_sha256", "round_trip"],
                )

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_ids, ids, decoded, decoded_sha256, round_trip) for each row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, n_ids long, ids array<int>, decoded string, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(*_shared(docs.sparkSession, model)), schema)


def _decode(tables, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(tables, key)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            text = m.decode_all(lists.flatten().to_numpy(zero_copy_only=False), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) for each row of ``encoded`` (doc_id, ids)."""
    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_decode(*_shared(encoded.sparkSession, model)), "doc_id long, text string")
