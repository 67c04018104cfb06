"""Vector operations on the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random value for each byte; from a rule, so that all workers agree.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def blocks(column: pa.Array, size: int = _BLOCK, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``rows`` rows and about ``size`` bytes; null is empty.

    A longer text is a block of its own, whole.
    """
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i below ``n``; kept for blocks of usual length only."""
    usual = n <= _BLOCK + 1
    if usual and name in _powers:
        return _powers[name]
    x = np.full(max(n, _BLOCK + 1), base, U64)
    x[0] = 1
    x = np.cumprod(x)
    if usual:
        _powers[name] = x
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, whatever its place."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * _power("up", _BASE, len(data))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of maximal runs of bytes that aren't white space, within rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:] & ~edge[1:], [False]))
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row of fewer words has one shingle, of all of them."""
    row, starts, ends = words(data, offsets)
    if not len(row):
        return row, np.zeros(0, U64)
    word = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(row)) - first[row]  # of the word in its row
    is_start = place <= np.maximum(count[row] - size, 0)
    at = np.flatnonzero(is_start)
    total = np.zeros(len(at), U64)
    for k in range(size):
        i = np.minimum(at + k, len(word) - 1)
        part = mix(word[i] + U64(k + 1))
        total += np.where(place[at] + k < count[row[at]], part, U64(0))
    return row[at], mix(total)


def bags(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of distinct values by row, sorted."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return r[at], v[at], np.diff(np.append(at, len(r)))
