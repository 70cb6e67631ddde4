"""Content-defined chunking with a rolling gear hash, vectorised."""

from __future__ import annotations

import numpy as np

WINDOW = 32


def _gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit words from a fixed mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).copy()
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i] = sum(GEAR[data[i-k]] << k for k < 32)`` modulo 2**32; equals the rolling ``h = (h << 1) + GEAR[b]``."""
    h = GEAR[data]
    step = 1
    while step < WINDOW and step < len(h):
        prev = h
        h = h.copy()
        h[step:] += prev[:-step] << np.uint32(step)
        step *= 2
    return h


def candidates(data: np.ndarray, bits: int, block: int = 1 << 18) -> np.ndarray:
    """Positions after which the top ``bits`` bits of the rolling hash are zero."""
    limit = np.uint32(1 << (32 - bits))
    found = []
    for at in range(0, len(data), block):
        lo = max(0, at - WINDOW + 1)
        hit = np.flatnonzero(gear_hashes(data[lo : at + block])[at - lo :] < limit)
        if len(hit):
            found.append(hit + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def boundaries(data: bytes | np.ndarray, bits: int = 12, least: int = 1024, most: int = 16384) -> list[int]:
    """Chunk ends of one payload, last one its length; an empty payload has one empty chunk.

    A cut is at a hash candidate at least ``least`` bytes (more than the hash window, so that it depends on the chunk's own
    bytes alone) after the chunk's start, or after ``most`` bytes.
    """
    arr = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray | memoryview) else data
    n = len(arr)
    if n <= least:
        return [n]
    cuts, start, cand, k = [], 0, candidates(arr, bits).tolist(), 0
    while n - start > least:
        while k < len(cand) and cand[k] < start + least:
            k += 1
        end = min(cand[k] if k < len(cand) else n, start + most, n)
        cuts.append(end)
        start = end
    if start < n:
        cuts.append(n)
    return cuts
