"""Whole-text token ids, equal to the tokenizer's own encoding, for whole columns at a time.

The vocabulary file's path is a parameter. Its normaliser and pre-tokeniser never join characters
across ASCII white space, so a text's ids are those of its words in turn. Words of plain characters
(ASCII, and letters of Latin-1) are cut into pieces of letters, digits and symbols on their bytes;
the distinct new pieces of a slice go through one vectorised byte-pair merge. Other words, and texts
that hold a special token's string, go through the whole tokenizer. Pieces are cached by a 64-bit
hash within a fixed bound, and a cached piece's bytes are compared before its ids are used.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import U, gather, slices, span_hashes, utf8

CACHE_ENTRIES = 200_000
#: bytes up to which a piece's merges are made beside others'; a merge a round would take long pieces too long
LONG_PIECE = 256
SLICE_BYTES = 1 << 20
#: fixed values: the split pattern and normalisers for which the cut into pieces below is right
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for characters from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairMerger:
    """Byte-pair merges of many pieces at once.

    All pieces lie in one flat array. Each round merges, in every unfinished piece, the leftmost pair
    of least rank, drops the merged positions and finished pieces, and looks up only the new pairs.
    """

    NONE = np.int64(1) << 30

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 19
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int64)
        left = np.arange(len(keys))
        slots = self._slot(keys)
        while len(left):  # open addressing: of the keys that want a free slot, one gets it
            free = self.keys[slots[left]] < 0
            want = left[free]
            _, one = np.unique(slots[want], return_index=True)
            got = want[one]
            self.keys[slots[got]], self.ranks[slots[got]] = keys[got], got
            left = np.setdiff1d(left, got, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        out = np.full(len(keys), self.NONE, np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[slots]
            hit = there == keys
            out[left[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there >= 0)
            left, keys, slots = left[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces that lie end to end in ``data``, and the number of ids of each."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stops = np.cumsum(lengths)
        sym = self.inner[data]
        sym[stops - 1] = self.last[data[stops - 1]]
        rank = np.full(len(sym), self.NONE, np.int64)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[stops - 1] = self.NONE
        starts, names = stops - lengths, np.arange(len(lengths))
        done_names, done_lengths, done_syms = [], [], []
        while len(names):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            go = best < self.NONE << 32
            lengths = np.diff(np.append(starts, len(sym)))
            if not go.all():
                done_names.append(names[~go])
                done_lengths.append(lengths[~go])
                done_syms.append(sym[np.repeat(~go, lengths)])
                if not go.any():
                    break
            at = best[go] & 0xFFFFFFFF
            sym[at] = self.made[rank[at]]
            keep = np.repeat(go, lengths)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            is_last = np.zeros(len(sym), bool)
            is_last[starts[1:] - 1] = True
            is_last[-1] = True
            ends_piece = is_last[at + 1]
            at, sym, rank = moved[at], sym[keep], rank[keep]
            names, lengths = names[go], lengths[go] - 1
            starts = np.cumsum(lengths) - lengths
            rank[at] = self.NONE
            right = at[~ends_piece]
            rank[right] = self.rank(sym[right], sym[right + 1])
            inside = np.ones(len(sym), bool)
            inside[starts] = False
            left = at[inside[at]] - 1
            rank[left] = self.rank(sym[left], sym[left + 1])
        names, lengths, syms = np.concatenate(done_names), np.concatenate(done_lengths), np.concatenate(done_syms)
        order = np.argsort(names)
        return gather(syms, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]


#: classes of bytes: white space, letter, digit, symbol, and what makes its word go through the whole tokenizer
_SPACE, _LETTER, _DIGIT, _SYMBOL, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SYMBOL
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[39] = _ODD  # an apostrophe may begin a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        self.full = Tokenizer.from_file(path)
        self.most = cache
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        split = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])]
        self.plain = _SPLIT in split and [n["type"] for n in norm.get("normalizers", [])] == _NORMALISERS and not model.get("continuing_subword_prefix")
        self.merger = PairMerger(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "") if self.plain else None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U)
        self.at = self.size = self.byte_at = self.length = np.zeros(0, np.int64)
        self.odd, self.bytes = np.zeros(0, bool), np.zeros(0, np.uint8)
        self.pool = np.zeros(0, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def _slice(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        kind = _CLASS[data]
        low = _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        fine = (tail != 0x97) & (tail != 0xB7)
        kind[lead[fine]] = kind[lead[fine] + 1] = _LETTER
        big = lead[fine & (tail < 0x9F)]
        low[big + 1] += 0x20
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            solid = kind != _SPACE
            first = solid.copy()
            first[1:] &= ~solid[:-1] | edge[1:n]
            word = np.cumsum(first) - 1
            bad = np.zeros(int(word[-1]) + 2, bool)
            bad[word[odd]] = True
            kind[bad[word] & solid] = _ODD
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:n]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(rows) - 1, np.int64)
        solid = np.append(kind != _SPACE, False)
        last = np.append(starts[1:], n)
        ends = np.where(solid[last - 1], last, 0)
        gap = np.flatnonzero(ends == 0)
        if len(gap):  # white space follows the piece: its end is the next space
            spaces = np.flatnonzero(~solid)
            ends[gap] = spaces[np.searchsorted(spaces, starts[gap])]
        is_odd = kind[starts] == _ODD
        lengths = ends - starts
        hashes = span_hashes(low, starts, ends)
        hashes[is_odd] = ~hashes[is_odd]
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        spot = np.searchsorted(self.known, distinct)
        spot_in = np.minimum(spot, max(0, len(self.known) - 1))
        new = (self.known[spot_in] != distinct) if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], spot[new], starts[where[new]], ends[where[new]], is_odd[where[new]], data, low)
            spot = np.searchsorted(self.known, distinct)
        spot = spot[which]
        at, sizes, pool = self.at[spot], self.size[spot], self.pool
        wrong = self._others(low, starts, lengths, is_odd, spot)
        if len(wrong):
            own = [self._piece(low[starts[i] : ends[i]], data[starts[i] : ends[i]], bool(is_odd[i])) for i in wrong.tolist()]
            sizes[wrong] = [len(x) for x in own]
            at[wrong] = len(pool) + np.cumsum(sizes[wrong]) - sizes[wrong]
            pool = np.concatenate([pool, *own])
        ids = gather(pool, at, sizes)
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(before[np.searchsorted(starts, rows)])

    def _others(self, low, starts, lengths, odd, spot) -> np.ndarray:
        """The pieces whose bytes are not those of the cached piece of their hash.

        The hash of spans of one length up to eight bytes is a bijection, so only longer ones are compared.
        """
        wrong = (lengths != self.length[spot]) | (odd != self.odd[spot])
        long = np.flatnonzero(~wrong & (lengths > 8))
        if len(long):
            size = lengths[long]
            differ = gather(low, starts[long], size) != gather(self.bytes, self.byte_at[spot[long]], size)
            wrong[long] = np.add.reduceat(differ, np.cumsum(size) - size) > 0
        return np.flatnonzero(wrong)

    def _piece(self, low, data, odd: bool) -> np.ndarray:
        if odd or len(low) > LONG_PIECE:
            return np.array(self._whole(data.tobytes().decode()), np.int64)
        return self.merger.encode(low, np.array([len(low)]))[0]

    def _learn(self, hashes, spots, starts, ends, odd, data, low) -> None:
        sizes, lengths = np.zeros(len(hashes), np.int64), ends - starts
        alone = odd | (lengths > LONG_PIECE)
        ids, sizes[~alone] = self.merger.encode(gather(low, starts[~alone], lengths[~alone]), lengths[~alone])
        parts, at = [ids], np.cumsum(sizes) - sizes
        total = len(ids)
        for i in np.flatnonzero(alone).tolist():
            own = self._whole(data[starts[i] : ends[i]].tobytes().decode())
            parts.append(np.array(own, np.int64))
            at[i], sizes[i] = total, len(own)
            total += len(own)
        at = at + len(self.pool)
        self.pool = np.concatenate([self.pool, *parts])
        byte_at = len(self.bytes) + np.cumsum(lengths) - lengths
        self.bytes = np.concatenate([self.bytes, gather(low, starts, lengths)])
        self.known = np.insert(self.known, spots, hashes)
        for name, values in (("at", at), ("size", sizes), ("byte_at", byte_at), ("length", lengths), ("odd", odd)):
            setattr(self, name, np.insert(getattr(self, name), spots, values))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column's texts end to end, and n + 1 offsets; a null or empty text has none."""
        n = len(column)
        column = column.cast(pa.large_string())
        alone = np.full(n, not self.plain)
        for s in self.special if self.plain else []:
            alone |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        parts, counts = [], []
        if alone.any():
            for text in column.to_pylist():
                ids, sizes = (np.array(self._whole(text or ""), np.int64), None) if not self.plain else self._one(text or "")
                parts.append(ids)
                counts.append(np.array([len(ids)]))
        elif n:
            data, offsets = utf8(column)
            for lo, hi in slices(offsets, SLICE_BYTES):
                ids, sizes = self._slice(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append(ids)
                counts.append(sizes)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def _one(self, text: str) -> tuple[np.ndarray, None]:
        if any(s in text for s in self.special):
            return np.array(self._whole(text), np.int64), None
        data = np.frombuffer(text.encode(), np.uint8)
        return self._slice(data, np.array([0, len(data)]))[0], None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
