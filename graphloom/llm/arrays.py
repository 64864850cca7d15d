"""Words and their 64-bit names, computed for many texts at once on the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its name is a polynomial over random 64-bit values of its bytes, mixed;
two words get one name with a chance of about 2**-64. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 19
#: Powers of a base that are kept between calls, at most.
KEPT_POWERS = 1 << 20

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled; one to one."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; up to KEPT_POWERS of them are kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U(base))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def give_back() -> None:
    """Return memory that is no longer used to the system; called where a task ends, as its Python worker serves later stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def rolling(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A name for each run of ``width`` values: at i for values[i:i+width]. Runs may cross texts; the caller leaves those out."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(base), n)[: n - width + 1])


class Words:
    """The words of some texts: ``start`` and ``end`` byte places in ``data``, ``name``, and ``first``: text i has words first[i]:first[i+1]."""

    def __init__(self, column: pa.Array, lower: bool = False, names: bool = True):
        if column.null_count:
            column = pc.fill_null(column, "")
        n = len(column)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        raw = column.buffers()[2] if n else None
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets - offsets[0]
        size = len(self.data)
        solid = np.zeros(size + 1, dtype=bool)
        solid[:size] = ~_SPACE[self.data]
        cut = np.zeros(size + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.zeros(size + 1, dtype=bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (cut | ~before))
        # A word ends before a space, at the end, or where a text begins.
        self.end = np.flatnonzero(before & (cut | ~solid))
        self.first = np.searchsorted(self.start, self.offsets)
        self.name = self._names() if names else None

    def _names(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.data] * powers(_P, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(inverse(_P), n + 1)[self.start])

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, at least a row each."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
