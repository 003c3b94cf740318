"""Fingerprints of 64 bits, and which of them are near: tiles in order of bit counts, compared by exclusive-or."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z in UTF-8.
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def tiles(x: np.ndarray, radius: int, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Places a and b of two tiles of x, a <= b, and which of their fingerprints are within radius; x is in order of bit counts.

    Tiles whose bit counts lie further apart than the radius are passed over, as no pair of theirs can be within it."""
    pops = np.bitwise_count(x).astype(int)
    for a in range(0, len(x), tile):
        for b in range(a, len(x), tile):
            if pops[b] - pops[min(a + tile, len(x)) - 1] > radius:
                break  # no later tile can be nearer
            yield a, b, np.bitwise_count(x[a : a + tile, None] ^ x[None, b : b + tile]) <= radius
