"""Word shingles of whole Arrow text batches as 64-bit hashes, in numpy.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D, with A-Z
lower-cased and nothing else folded. A document's shingles are its runs of ``width``
words; a text of one to ``width - 1`` words has one shingle, the whole sequence; a text
that is null or has no word has none. Hashes depend on the words alone, so they agree
across batches, partitions and sessions. Two different shingles share a 64-bit hash with
a chance of about 5e-20 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_SLICE_BYTES = 1 << 19
_PLACES = 64
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(n: int, start: int) -> np.ndarray:
    return mix64((np.arange(start, start + n, dtype=np.uint64)) * _U(0x9E3779B97F4A7C15))


_BYTE_AT = _stream(_PLACES * 256, 1)  # a random value for each (place in the word, byte)
_WORD_AT = _stream(64, 1 << 40) | _U(1)  # an odd multiplier for each place in the shingle
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, joined, and where each row starts (n + 1 offsets). Null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows ``raw[at[i]:at[i + 1]]``, and how many words each row has."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < at[1:]]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[rows[1:] - 1] = inside[rows[1:] - 1]
    ends = np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    letters = np.flatnonzero(inside)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(letters)) - np.repeat(heads, lengths)
    value = _BYTE_AT[(place % _PLACES) * 256 + _LOWER[raw[letters]]]
    if lengths.max() > _PLACES:
        value = value * (2 * (place // _PLACES) + 1).astype(np.uint64)
    return mix64(np.add.reduceat(value, heads)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in row order, repeats included, and how many each row has."""
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = np.zeros(int(n.sum()), np.uint64)
    to = np.concatenate(([0], np.cumsum(n)))[:-1]
    long = counts >= width
    if long.any():
        size = n[long]
        row_start = np.repeat(to[long], size)
        step = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        source = np.repeat(begin[long], size) + step
        total = np.zeros(len(source), np.uint64)
        for k in range(width):
            total += words[source + k] * _WORD_AT[k]
        out[row_start + step] = mix64(total)
    for k in range(1, width):
        if (some := counts == k).any():
            total = np.full(int(some.sum()), _U(k))
            for j in range(k):
                total += words[begin[some] + j] * _WORD_AT[j]
            out[to[some]] = mix64(total)
    return out, n


def slices(at: np.ndarray, most: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes at the most; a longer row is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each row, its distinct shingle hashes in ascending order."""
    for i, j in slices(at):
        words, counts = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        all_of, n = shingle_hashes(words, counts, width)
        end = np.cumsum(n)
        for a, b in zip(end - n, end, strict=True):
            own = all_of[a:b]
            if b - a > 1:
                own.sort()
                keep = np.empty(b - a, bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            yield own
