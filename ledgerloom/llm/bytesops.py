"""Vectorised work on the bytes of a text column: slices, units, 64-bit unit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed together; a span may be longer.
BLOCK = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int) -> np.ndarray:
    """base**0 .. base**BLOCK modulo 2**64."""
    if base not in _powers:
        have = np.full(BLOCK + 1, base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 256 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) in runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def doc_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    return first


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes that are not ASCII white space."""
    inside = ~SPACE[data]
    first = doc_starts(len(data), offsets)
    head = inside.copy()
    head[1:] &= ~inside[:-1] | first[1:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands; spans in order, apart.

    The bytes are looked at in blocks, so that the sums take memory for BLOCK bytes, not for all.
    """
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        if ends[stop - 1] - first > BLOCK:
            out[k] = _long_sum(data[first : ends[k]])
        else:
            own = data[first : ends[stop - 1]]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(_BASE)[: len(own)], out=sums[1:])
            at = starts[k:stop] - first
            out[k:stop] = (sums[ends[k:stop] - first] - sums[at]) * powers(_INV)[at]
        k = stop
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _long_sum(data: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(data), BLOCK):
        own = data[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
        total += int((own * powers(_BASE)[: len(own)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64(total & _MASK)


class UnitTable:
    """Ids and a flag of each distinct unit seen by this worker; cleared whenever it holds `most` units.

    `encode` gives both for a list of units. Hashes are kept in two sorted arrays, of which the
    smaller takes new ones, so a unit costs some 40 bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[list[int]], np.ndarray | bool]], most: int = 500_000, dtype: type = np.uint16):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.clear()

    def clear(self) -> None:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.recent, self.n = nothing, nothing, 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.flag = np.zeros(1 << 14, bool)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each unit data[start:end]; new distinct units are encoded once."""
        if self.n > self.most:
            self.clear()
        distinct, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        found = np.full(len(distinct), -1, np.int64)
        for keys, values in (self.old, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                found = np.where(keys[at] == distinct, values[at], found)
        if len(new := np.flatnonzero(found < 0)):
            raw = data.tobytes()
            units = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            found[new] = np.arange(self.n, self.n + len(new))
            self._add(*self.encode(units))
            self.recent = _merged(self.recent, (distinct[new], found[new].astype(np.int32)))
            if 8 * len(self.recent[0]) > len(self.old[0]):
                self.old, self.recent = _merged(self.old, self.recent), (distinct[:0], new[:0].astype(np.int32))
        return found[inverse]

    def _add(self, ids: list[list[int]], flags: np.ndarray | bool) -> None:
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, have = int(sizes.sum()), self.n
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.dtype)])
        while have + len(ids) > len(self.start):
            self.start, self.size, self.flag = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.start, self.size, self.flag))
        self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.dtype, total)
        self.start[have : have + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[have : have + len(ids)] = sizes
        self.flag[have : have + len(ids)] = flags
        self.used += total
        self.n += len(ids)

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the units, one after the other."""
        sizes = self.size[entries].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[entries] - (ends - sizes), sizes) + np.arange(total)]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def row_sums(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sums of `values` by row, as integers."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    return sums[at[1:]] - sums[at[:-1]]
