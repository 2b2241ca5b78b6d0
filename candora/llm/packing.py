"""Compact binary columns for sorted hashes and small counts."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few byte planes as the largest needs, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).reshape(-1)


def pack_keys(keys: np.ndarray, spare: int = 0) -> bytes:
    """Sorted 64-bit keys as differences; their lowest ``spare`` bits must be 0 and are left out."""
    short = keys >> np.uint64(spare)
    low = short[:1] if len(short) else np.zeros(1, np.uint64)
    return bytes([spare]) + low.astype(np.uint64).tobytes() + pack(np.diff(short, prepend=low))


def unpack_keys(blob: bytes) -> np.ndarray:
    low = np.frombuffer(blob[1:9], np.uint64)
    return (np.add.accumulate(unpack(blob[9:])) + low) << np.uint64(blob[0])


def range_slices(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """Ranges of the 64-bit hash space that hold any of the sorted ``keys``, and where in ``keys``."""
    if not len(keys):
        return []
    number = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return [(int(number[a]), slice(int(a), int(b))) for a, b in zip(first, np.r_[first[1:], len(keys)], strict=True)]
