"""Vectorised words, shingles and hashes straight from Arrow string buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. No
byte of a longer UTF-8 sequence is one of these, so working on bytes gives the words of the text. Nothing here looks
at a prefix: long texts are hashed piece by piece, cut at separators, so that working memory stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21  # bytes hashed at a time; bounds working memory

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset at which each row starts (one more than rows); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high
        low = high


@dataclass
class Words:
    """Words of several texts in order: 64-bit hash, byte range, and the row each belongs to."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry than rows

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _cuts(data: np.ndarray, limit: int) -> list[int]:
    """Positions at which ``data`` can be cut without cutting a word, about ``limit`` bytes apart."""
    cuts, at = [0], limit
    while at < len(data):
        step = 4096
        while at < len(data):
            found = np.flatnonzero(_SEPARATOR[data[at : at + step]])
            if len(found):
                at += int(found[0])
                break
            at += step
            step *= 2
        if at < len(data):
            cuts.append(at)
        at += limit
    return [*cuts, len(data)]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Split and hash the words of all rows; ``lower`` turns A-Z into a-z first."""
    hashes, starts, ends = [], [], []
    bounds = np.unique(offsets)
    cuts = _cuts(data, PIECE_BYTES)
    for low, high in zip(cuts, cuts[1:], strict=False):
        piece = data[low:high]
        if not len(piece):
            continue
        inside = ~_SEPARATOR[piece]
        edges = bounds[(bounds > low) & (bounds < high)] - low
        follows = np.empty(len(piece), bool)
        follows[0] = False
        follows[1:] = inside[:-1]
        follows[edges] = False
        start = np.flatnonzero(inside & ~follows)
        if not len(start):
            continue
        precedes = np.empty(len(piece), bool)
        precedes[-1] = False
        precedes[:-1] = inside[1:]
        precedes[edges - 1] = False
        end = np.flatnonzero(inside & ~precedes) + 1
        chars = piece[inside]
        if lower:
            chars = _LOWER[chars]
        size = end - start
        begin = np.cumsum(size) - size
        local = np.arange(len(chars)) - np.repeat(begin, size)
        powers = np.full(int(size.max()), _POWER)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        hashes.append(mix(np.add.reduceat(_BYTE_KEYS[chars] * powers[local], begin)))
        starts.append(start + low)
        ends.append(end + low)
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        start,
        np.concatenate(ends) if ends else none,
        row,
        np.searchsorted(start, offsets),
    )


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, as far as there are that many (row ends are not looked at)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    rows = len(hashes) - n + 1
    total = hashes[:rows].copy()
    for k in range(1, n):
        total = total * _POWER + hashes[k : k + rows]
    return mix(total)


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``n``-word shingle; a row of fewer words (but one at least) has one of all its words."""
    gram = ngram_hashes(found.hash, n)
    whole = found.row[: len(gram)] == found.row[n - 1 :][: len(gram)]
    values, rows = [gram[whole]], [found.row[: len(gram)][whole]]
    counts = found.counts()
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            total = found.hash[found.first[short]].copy()
            for k in range(1, size):
                total = total * _POWER + found.hash[found.first[short] + k]
            values.append(mix(total + np.uint64(size)))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return value[order], row[order]


def distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ordered by row and value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.empty(len(value), bool)
        new[0] = True
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, row
