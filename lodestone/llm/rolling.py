"""64-bit hashes of many slices of one buffer at once, from a prefix sum of powers modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, so that each has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        held = _powers[base] = (out[0], out[1])
    return held[0][:n], held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slice_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Of data[a:b] for each a, b. Equal bytes have equal hashes wherever they stand."""
    up, down = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
