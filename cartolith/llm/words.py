"""Words, lines and their 64-bit hashes, read straight from Arrow string buffers.

A word is a longest run of bytes other than space and 0x09-0x0D; UTF-8
continuation bytes never fall among those, so bytes do for code points. All
functions work on one flat byte array with document offsets, never on Python
strings, and cut their work into bounded slices, so a task's memory depends on
its longest document and not on its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_LOWERED = _BYTE.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def _places(start: int, stop: int) -> np.ndarray:
    """A fixed random odd number for each place in a span."""
    return mix((np.arange(start, stop, dtype=np.uint64) + np.uint64(257)) * _GOLDEN) | np.uint64(1)


_PLACES = _places(0, 1 << 14)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + 65536)
        yield i, j
        i = j


class Words(NamedTuple):
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past its last byte
    first: np.ndarray  # index of each document's first word, and the number of words


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def find_lines(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lines split at newlines: one more than the newlines of a document, even of an empty one."""
    breaks = np.flatnonzero(data == 10)
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate(([0], np.cumsum(per_doc)))
    starts = np.empty(first[-1], np.int64)
    later = np.ones(first[-1], bool)
    later[first[:-1]] = False
    starts[first[:-1]] = offsets[:-1]
    starts[later] = breaks + 1
    ends = np.empty_like(starts)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last] = offsets[1:]
    ends[~last] = breaks
    return Words(starts, ends, first)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``lower`` reads A-Z as a-z.

    Each byte's random number times that of its place in the span, summed: two
    different spans get one hash with odds below one in 2**48, whatever pattern
    their bytes follow, as each place has a factor of its own.
    """
    out = np.zeros(len(starts), np.uint64)
    table = _LOWERED if lower else _BYTE
    sizes = ends - starts
    for k in np.flatnonzero(sizes > len(_PLACES)):
        for at in range(int(starts[k]), int(ends[k]), SLICE_BYTES):
            upto = min(at + SLICE_BYTES, int(ends[k]))
            out[k : k + 1] += (table[data[at:upto]] * _places(at - int(starts[k]), upto - int(starts[k]))).sum(dtype=np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes <= len(_PLACES)))
    cuts = np.concatenate(([0], np.cumsum(sizes[short])))
    i = 0
    while i < len(short):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SLICE_BYTES, "right")) - 1)
        begin, lengths = cuts[i:j] - cuts[i], sizes[short[i:j]]
        place = np.arange(cuts[j] - cuts[i]) - np.repeat(begin, lengths)
        values = table[data[place + np.repeat(starts[short[i:j]], lengths)]] * _PLACES[place]
        out[short[i:j]] = np.add.reduceat(values, begin)
        i = j
    return mix(out + sizes.astype(np.uint64) * _GOLDEN)


def runs(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of ``width`` words, and the first run of each document.

    A document of fewer words, but some, has one run of all of them.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], sizes)
    left = np.repeat(np.minimum(counts, width), sizes)
    out = np.zeros(begin[-1], np.uint64)
    for k in range(width):
        inside = left > k
        if inside.all():
            out = out * _GOLDEN + hashes[at + k]
        else:
            out[inside] = out[inside] * _GOLDEN + hashes[at[inside] + k]
    return mix(out + left.astype(np.uint64)), begin
