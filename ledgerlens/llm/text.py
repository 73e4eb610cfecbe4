"""Words and shingles of whole text columns, computed on Arrow buffers.

An Arrow string column is one byte buffer with offsets.  Words are found and hashed for many texts
at once by array operations on that buffer; no Python string is made.  Work goes in slices of a
few megabytes, so memory does not follow the size of a batch; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and the bytes of other scripts separates plain words.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices of about SLICE_BYTES; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds in words) of the maximal runs of non-separators; no run crosses a text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, whatever its place in the buffer."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


_PLACES = mix(np.arange(101, 201, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def combine(words: np.ndarray, offsets: tuple[int, ...], n: int) -> np.ndarray:
    """Hash of the words at ``offsets`` from each of the first ``n`` places."""
    total = np.full(n, len(offsets), np.uint64)
    for i, offset in enumerate(offsets):
        total += words[offset : offset + n] * _PLACES[i]
    return mix(total)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each text: lower-cased A-Z, words between white space.

    A text of fewer words than ``size`` gives its whole word sequence as one shingle; one without
    words gives none.
    """
    data = LOWER[data]
    starts, ends, at = word_spans(data, bounds, SPACE)
    words = hash_spans(data, starts, ends)
    count = len(words)
    full = combine(words, tuple(range(size)), max(count - size + 1, 0)) >> np.uint64(1)
    sets = []
    for i in range(len(bounds) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            sets.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            sets.append(combine(words[a:b], tuple(range(b - a)), 1) >> np.uint64(1))
        else:
            sets.append(full[:0])
    return sets


def arrow_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> array with one list per part."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
