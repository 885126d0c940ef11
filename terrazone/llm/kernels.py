"""NumPy kernels over concatenated UTF-8 text, shared by the Arrow-batched operators.

All of them work on a few hundred documents at once, so the interpreter is entered per slice of about
half a megabyte and not per document or word. Hashes are 64-bit and used to propose matches; where an operator's
contract is exact, it verifies them or says why a collision is out of reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Words of the near-duplicate contract: runs without ASCII white space.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Words of the decontamination contract: ASCII letters and digits, and every byte beyond ASCII.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x *= _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without copying; nulls must be empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most `most` bytes each, or a single longer document."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Texts:
    """Some documents laid end to end, `gap` spaces before the first and after each, then spare bytes for wide loads."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, gap: int = 1):
        n = len(off) - 1
        lens = np.diff(off)
        self.starts = np.full(n + 1, gap, dtype=np.int64)
        self.starts[1:] += np.cumsum(lens + gap)
        buf = np.full(int(self.starts[-1]) + 8, 0x20, dtype=np.uint8)
        for k in range(n):
            buf[self.starts[k] : self.starts[k] + lens[k]] = data[off[k] : off[k + 1]]
        self.buf = LOWER[buf] if lower else buf
        self.lens = lens
        self.n = n

    def wide(self) -> np.ndarray:
        """The eight bytes from each position as one unaligned little-endian integer."""
        return np.ndarray(shape=(len(self.buf) - 7,), dtype="<u8", buffer=self.buf, strides=(1,))

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each document's first word (n + 1 entries)."""
        inside = table[self.buf].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, np.searchsorted(starts, self.starts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        return spans(self.wide(), starts, ends)


def spans(wide: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from a view of eight bytes at each position."""
    lens = ends - starts
    h = lens.astype(np.uint64) * _GOLD
    h = mix(h ^ (wide[starts] & _LOW[np.minimum(lens, 8)]))
    k, live = 8, np.flatnonzero(lens > 8)
    while len(live):
        rest = np.minimum(lens[live] - k, 8)
        h[live] = mix((h[live] * _GOLD) ^ (wide[starts[live] + k] & _LOW[rest]))
        k += 8
        live = live[lens[live] > k]
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbours; the caller drops runs that cross documents. Built by doubling."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have, run, step = None, 0, h, 1
    while True:
        if n & step:
            part = run[have:] if have else run
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = mix(out[:m] * _GOLD + part[:m])
            have += step
        step *= 2
        if step > n:
            return mix(out[: len(h) - n + 1] + np.uint64(n))
        half = step // 2
        run = mix(run[:-half] * _C1 + run[half:])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start .. start + len of every run, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
