"""Vectorised word, window and shingle hashing over Arrow string columns.

Everything here is a small NumPy kernel that runs inside a Spark task on one
bounded slice of rows.  Words are the maximal runs of bytes outside the ASCII
white space set (space, tab, LF, VT, FF, CR), so they equal the regular
expression ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text handled by one kernel call; bounds a worker's scratch memory.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection on 64-bit integers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = {s: np.where(_SPACE, _U(0), _splitmix(256, 1000 * s)) for s in (0, 1)}
_PLACE: dict[int, np.ndarray] = {}


def _places(seed: int, n: int) -> np.ndarray:
    """A random number for each place in a word."""
    have = _PLACE.get(seed)
    if have is None or len(have) < n:
        have = _PLACE[seed] = _splitmix(max(n, 1024), 5_000_000_000 + seed * 7_000_000_000)
    return have


class Words:
    """The words of a run of texts: byte spans, owning row and 64-bit hashes."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        space = _SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        #: index of the first word of each row, and one past the last at the end
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row that owns each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0, data: np.ndarray | None = None) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        data = self.data if data is None else data
        lead = int(self.starts[0])
        lens = np.diff(np.append(self.starts, len(data)))
        pos = np.arange(len(data) - lead, dtype=np.int32) - np.repeat((self.starts - lead).astype(np.int32), lens)
        # each (byte, place) has a number of its own: sums of products would follow algebra that texts can hit
        value = _BYTE[seed][data[lead:]]
        inside = value != 0
        value ^= _places(seed, int(lens.max()) + 1)[pos]
        value *= _U(0xFF51AFD7ED558CCD)
        value ^= value >> _U(29)
        value *= inside
        out = np.add.reduceat(value, self.starts - lead)
        return mix(out + (self.ends - self.starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (rows are not minded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += h[j : j + n]
    return mix(out)


def window_starts(w: Words, k: int) -> np.ndarray:
    """Word positions at which a window of k words lies inside one row."""
    n = len(w.starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, dtype=bool)
    last = np.repeat(w.first[1:], w.counts)[:n]
    ok &= np.arange(n) + k <= last
    return np.flatnonzero(ok)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = column.cast(pa.large_binary()).fill_null(b"")
    lens = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    group = (np.cumsum(lens) - lens) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    at = 0
    for cut in [*cuts.tolist(), len(lens)]:
        if cut > at:
            yield batch.slice(at, cut - at)
        at = cut
