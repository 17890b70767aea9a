"""Vectorised text helpers used inside Arrow tasks.

Everything here works on one slice of an Arrow batch at a time: the UTF-8 bytes of many
documents lie one after another in a single numpy array, so words, shingles and their hashes
come from a handful of array operations and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are turned into arrays at once; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 2 << 20
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256

_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in one array, and where each begins and ends; null counts as empty."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents after A-Z are lower-cased.

    ``start``/``end`` are byte positions, ``first`` the index of each document's first word (one
    more entry than documents), ``hash`` a 64-bit hash of each word.
    """

    def __init__(self, col: pa.Array, lower: bool = True):
        raw, at = flat(col)
        n = len(raw)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = raw
        if lower:
            up = (padded >= 65) & (padded <= 90)
            padded[up] += 32
        sep = (padded[:n] == 32) | ((padded[:n] >= 9) & (padded[:n] <= 13))
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        word = ~sep
        begins = word.copy()
        begins[1:] &= sep[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= sep[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.bytes, self.at = padded, at
        self.hash = self._hashed(padded, n)

    def _hashed(self, padded: np.ndarray, n: int) -> np.ndarray:
        length = self.end - self.start
        h = mix64(length.astype(np.uint64) * _P + np.uint64(1))
        if not len(h):
            return h
        eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        short = np.flatnonzero(length <= LONG_WORD)
        step = 0
        while len(short):
            rest = np.minimum(length[short] - 8 * step, 8)
            chunk = eight[self.start[short] + 8 * step] & _MASKS[rest]
            h[short] = mix64((h[short] ^ chunk) * _P)
            step += 1
            short = short[length[short] > 8 * step]
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = np.uint64(xxhash.xxh64_intdigest(padded[self.start[i] : self.end[i]].tobytes()))
        return h

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word shingles in text order, and each document's first one.

        A document of fewer than ``k`` words, but one at least, has its whole sequence as one.
        """
        w, first = self.hash, self.first
        m = np.diff(first)
        if len(w) >= k:
            h = w[: len(w) - k + 1].copy()
            for j in range(1, k):
                h = h * _P + w[j : len(w) - k + 1 + j]
            h = mix64(h)
        else:
            h = np.zeros(0, np.uint64)
        per = np.where(m >= k, m - k + 1, (m > 0).astype(m.dtype))
        at = np.concatenate([[0], np.cumsum(per)])
        keep = np.zeros(len(w) + 1, np.int8)
        full = np.flatnonzero(m >= k)
        np.add.at(keep, first[full], 1)
        np.add.at(keep, first[full + 1] - k + 1, -1)
        inside = np.cumsum(keep[:-1]).astype(bool)[: len(h)]
        out = np.zeros(at[-1], np.uint64)
        spot = np.ones(at[-1], bool)
        few = np.flatnonzero((m > 0) & (m < k))
        spot[at[few]] = False
        out[spot] = h[inside]
        for i in few:
            place = np.arange(1, m[i] + 1, dtype=np.uint64) * _M2
            out[at[i] : at[i] + 1] = mix64(np.add.reduce(mix64(w[first[i] : first[i + 1]] ^ place), keepdims=True) + place[-1:])
        return out, at


def sorted_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order, and where each document's begin."""
    h = h.copy()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s > 1:
            h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][at[:-1] < len(h)]] = True
    size = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], size[at]


def set_digest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of each document's sorted set of hashes (0 entries: digest of none)."""
    n = np.diff(at)
    a = np.zeros(len(n), np.uint64)
    b = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        a[full] = np.add.reduceat(mix64(h ^ _P), at[:-1][full])
        b[full] = np.bitwise_xor.reduceat(mix64(h + _M2), at[:-1][full])
    return mix64(a * _P + mix64(b) + n.astype(np.uint64)).view(np.int64)
