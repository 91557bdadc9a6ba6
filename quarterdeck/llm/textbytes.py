"""Vectorised words, hashes and shingles over the UTF-8 bytes of Arrow string columns.

Texts are handled as one byte array per piece, so no Python string is made per word. A
substring's hash is the difference of two prefix sums of a polynomial over 64-bit wrap-around
arithmetic, scaled back to the start of the substring and mixed; equal substrings have equal
hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = 0xD6E8FEB86659FD93
PIECE_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for slot, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(max(n, 2 * len(_powers[slot])), base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lookup(kept, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Tables by byte: is it part of a word; its value with A-Z lowered (if ``fold``)."""
    inside = np.array([bool(kept(b)) for b in range(256)])
    value = np.arange(256, dtype=np.uint8)
    if fold:
        value[65:91] += 32
    return inside, value


#: Words of bytes outside white space; words of lower-cased ASCII letters, digits and all non-ASCII bytes.
NON_SPACE = lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = lookup(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end and the len+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_sums(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over ``value`` of each byte."""
    forward, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((value[data].astype(np.uint64) + np.uint64(1)) * forward[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range."""
    _, back = powers(len(sums))
    return mix((sums[end] - sums[start]) * back[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the len+1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
    """Word hashes, byte starts and ends, and word offsets of the texts."""
    inside, value = table
    start, end, at = word_spans(data, offsets, inside)
    return span_hash(prefix_sums(data, value), start, end), start, end, at


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (len - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    factor = 1
    for j in range(1, size):
        factor = factor * _GRAM % 2**64
        total += words[j : j + n] * np.uint64(factor)
    return mix(total + np.uint64(size))


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate(([True], values[1:] != values[:-1]))]
    return values
