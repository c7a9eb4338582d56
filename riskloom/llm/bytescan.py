"""Numpy scans over the UTF-8 bytes of whole Arrow batches: texts, words and 64-bit span hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

#: The bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        _tables["bytes"] = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for key, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(WINDOW + 1, base, dtype=np.uint64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps)
    return _tables[name]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (wraps around)."""
    h = h + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and where each text starts (one more: the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes together; a longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes other than separators) and the number of words of each text."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    last[before] = solid[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap.

    Polynomial in an odd base modulo 2**64 over a random value for each byte, then scrambled with
    the length. Works in windows of 1 MB, so memory does not grow with the text.
    """
    table, powers, inverse = _table("bytes"), _table("powers"), _table("inverse")
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + WINDOW, "right"))
        if j <= i:
            total = 0
            for at in range(int(starts[i]), int(ends[i]), WINDOW):
                part = table[data[at : min(at + WINDOW, int(ends[i]))]]
                total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - int(starts[i]), 1 << 64)
            out[i] = total & _MASK
            i += 1
            continue
        low = int(starts[i])
        part = table[data[low : int(ends[j - 1])]]
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))
