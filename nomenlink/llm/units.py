"""Texts of an Arrow batch as arrays: bytes, words and their hashes.

Hashes are 64 bit, computed with wrapping arithmetic from fixed random tables,
so every task of every run gives a text the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@cache
def _lowered_values() -> np.ndarray:
    values = _byte_values().copy()
    values[65:91] = values[97:123]
    return values


@cache
def _is_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        size = 1 << max(10, (count - 1).bit_length())
        known = np.full(size, np.uint64(base), dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[base] = known
    return known[:count]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, bytes, bounds of the rows.

    A longer text is a block of its own. Null rows must be filled before.
    """
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial prefix sums; see ``span_hash``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each span, a function of its values alone."""
    inverse = _powers(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def gram_hash(prefix: np.ndarray, length: int, begin: int, stop: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all spans of one length that start from ``begin`` to before ``stop``."""
    stop = min(stop, len(prefix) - length)
    if stop <= begin:
        return np.zeros(0, dtype=np.uint64)
    inverse = _powers(pow(base, -1, 1 << 64), stop)[begin:]
    return mix((prefix[begin + length : stop + length] - prefix[begin:stop]) * inverse)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _byte_values()[data]


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """Words of each row: starts, ends, hashes, and bounds of the rows in them.

    A word is a longest run of bytes other than space and 9 to 13; ``lower``
    folds A to Z.
    """
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = ~_is_space()[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    table = _lowered_values() if lower else _byte_values()
    hashes = span_hash(prefix_hash(table[data]), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, bounds, side="left")


def shingles(hashes: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: hashes sorted within the row, and its bounds.

    A row of fewer words than ``length`` has its whole sequence as its only
    shingle; a row without words has none.
    """
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(len(hashes), dtype=np.uint64)
    spot = np.arange(len(hashes)) - rows[row_of] if len(hashes) else np.zeros(0, np.int64)
    size = np.minimum(length, counts)[row_of] if len(hashes) else spot
    valid = spot + size <= counts[row_of] if len(hashes) else np.zeros(0, bool)
    for step in range(length):
        reach = len(hashes) - step
        if reach <= 0:
            break
        factor = np.uint64(pow(_BASE, step + 1, 1 << 64))
        part = hashes[step:] * factor
        total[:reach] += np.where(size[:reach] > step, part, np.uint64(0))
    total = mix(total + size.astype(np.uint64))
    total, owner = total[valid], row_of[valid]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.ones(len(total), dtype=bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[fresh], owner[fresh]
    return total, np.searchsorted(owner, np.arange(len(counts) + 1), side="left")
