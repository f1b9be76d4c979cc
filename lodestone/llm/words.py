"""Vectorised word scan: word bounds and 64-bit word hashes of whole batches of texts.

Words are hashed by chained lanes of eight bytes and windows by chained word hashes, each step through
a bijective finaliser, so no algebra of positions makes two texts collide. Where equality of hashes
removes, links or encodes something, the operators compare the strings (or digests of them) as well.

A word is a run of characters other than space and ``\\x09``-``\\x0D``. The scan works on the
UTF-8 bytes of a slice of rows at a time, so memory follows the slice and the longest single text.
A null text has no words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEY = U(0x5851F42D4C957F2D)
#: bytes of a word up to which it is hashed by lanes of eight
LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the sequence of two hashes."""
    return mix(a * U(0x9E3779B97F4A7C15) + (b ^ KEY))


def chained(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` values from each position on, by doubling; each step goes through ``mix``."""
    n = len(values)
    if n < k:
        return np.zeros(0, U)
    out, have, power, size = None, 0, values, 1
    while size <= k:
        if k & size:
            m = n - have - size + 1
            out, have = (power, size) if out is None else (joined(out[:m], power[have : have + m]), have + size)
        if 2 * size <= k:
            power = joined(power[: n - 2 * size + 1], power[size:])
        size *= 2
    return joined(out, np.full(1, k, U))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made small."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: chained over lanes of eight bytes, or BLAKE2 for long spans; each salt gives another."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    out = mix(lengths.astype(U) + KEY + U(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    long = lengths > LONG
    todo, at = (np.flatnonzero(~long) if long.any() else slice(None)), 0
    while True:
        left = lengths[todo] - at
        out[todo] = mix(out[todo] ^ (lanes[starts[todo] + at] & _MASKS[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        todo, at = (more if isinstance(todo, slice) else todo[more]), at + 8
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    return out


class Scan:
    """Words of the texts of some rows.

    data: their bytes; rows: n + 1 byte offsets; starts, ends: byte bounds of the words;
    first: n + 1 offsets of each row's words; hashes: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, rows: np.ndarray, lower: bool, hashed: bool = True, salt: int = 0):
        self.data, self.rows = data, rows
        n = len(data)
        solid = ~_WS[data]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:n]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, rows)
        self.n_rows = len(rows) - 1
        if hashed:
            self.hashes = span_hashes(lowered(data) if lower else data, self.starts, self.ends, salt)

    def begins(self, k: int) -> np.ndarray:
        """First word (numbered in this scan) of every window of ``k`` words within one row."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        return np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``begins(k)``, and a hash of each window."""
        begin = self.begins(k)
        return begin, chained(self.hashes, k)[begin] if len(begin) else np.zeros(0, U)

    def shorter(self, k: int) -> dict[int, np.uint64]:
        """A hash of the whole word sequence of each row of 1 to ``k`` - 1 words."""
        counts, out = np.diff(self.first), {}
        for size in range(1, k):
            own = np.flatnonzero(counts == size)
            if len(own):
                out |= dict(zip(own.tolist(), chained(self.hashes, size)[self.first[own]], strict=True))
        return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans [start, start + length) of ``pool``, end to end."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return pool[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text makes a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def scans(column: pa.Array, lower: bool = False, hashed: bool = True, salt: int = 0) -> Iterator[tuple[int, Scan]]:
    """For each slice of the column: the number of its first row, and its scan."""
    if not len(column):
        return
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        yield lo, Scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, hashed, salt)


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker doesn't keep a task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def runs(batches, most_rows: int = 1024, most_bytes: int = 4 << 20):
    """The batches in runs of few rows and bytes, so that what is made of a run stays small; a longer text is a run."""
    try:
        for b in batches:
            at = b.schema.get_field_index("text")
            _, offsets = utf8(b.column(at)) if b.num_rows else (None, np.zeros(1, np.int64))
            for lo, hi in slices(offsets, most_bytes):
                for i in range(lo, hi, most_rows):
                    yield b.slice(i, min(most_rows, hi - i))
    finally:
        release()
