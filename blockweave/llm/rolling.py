"""Hashes of very many substrings of a text at once, by a polynomial over its code points."""

from __future__ import annotations

import functools

import numpy as np

#: Base of the polynomial modulo 2**64, odd so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Code points that are hashed at a time.
CHUNK = 1 << 18
#: Multipliers of the splitmix64 finalizer.
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.lru_cache(maxsize=2)
def powers(base: int) -> np.ndarray:
    """base ** k modulo 2**64 for k up to CHUNK."""
    out = np.full(CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of up to CHUNK code points; equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE)[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(UNBASE)[starts]


def long_hash(codes: np.ndarray) -> int:
    """span_hashes of one span of any length, a chunk at a time."""
    total = 0
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        total += int(np.sum(part * powers(BASE)[: len(part)], dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return total & (1 << 64) - 1


def scatter(z: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    for shift, factor in ((30, M1), (27, M2)):
        z = (z ^ (z >> np.uint64(shift))) * factor
    return z ^ (z >> np.uint64(31))
