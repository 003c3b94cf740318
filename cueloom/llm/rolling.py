"""Rolling hashes and window minima over numpy arrays, and packing of hashes for shuffles."""

from __future__ import annotations

import numpy as np

#: Bytes that one step of byte hashing looks at; longer runs are cut, words are not.
STEP = 1 << 20
_R = np.random.default_rng(20_240_501)
TABLE = _R.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers() -> np.ndarray:
    """BASE ** i modulo 2 ** 64, for i up to STEP."""
    if not _POWERS:
        p = np.full(STEP + 1, BASE)
        p[0] = 1
        _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[begin:end] for each word; words are in order and don't overlap."""
    p, out, k = powers(), np.empty(len(begins), np.uint64), 0
    while k < len(begins):
        stop = int(np.searchsorted(ends, begins[k] + STEP, "right"))
        if stop <= k:  # a word of more than STEP bytes
            from xxhash import xxh64_intdigest

            out[k] = xxh64_intdigest(raw[begins[k] : ends[k]].tobytes(), 7)
            k += 1
            continue
        b, e = begins[k:stop] - begins[k], ends[k:stop] - begins[k]
        part = raw[begins[k] : ends[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(TABLE[part] * p[: len(part)], out=sums[1:])
        out[k:stop] = mixed((sums[e] - sums[b]) * p[STEP - b])
        k = stop
    return out


def window_hashes(values: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = values[:m].copy()
    for k in range(1, n):
        h *= np.uint64(factor)
        h += values[k : k + m]
    return mixed(h)


def byte_windows(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive bytes; n is far under STEP."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    p, out = powers(), np.empty(m, np.uint64)
    for at in range(0, m, STEP - n):
        part = raw[at : at + STEP]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(TABLE[part] * p[: len(part)], out=sums[1:])
        k = min(STEP - n, m - at)
        out[at : at + k] = (sums[n : n + k] - sums[:k]) * p[STEP - np.arange(k)]
    return mixed(out)


def window_minima(h: np.ndarray, w: int, most: bool = False) -> np.ndarray:
    """The least (or largest) of each w consecutive values, in two passes whatever w is."""
    m = len(h) - w + 1
    if m <= 0:
        return h[:0]
    best = np.maximum if most else np.minimum
    filler = h.dtype.type(0) if most else np.iinfo(h.dtype).max
    padded = np.concatenate([h, np.full(-len(h) % w, filler, h.dtype)]).reshape(-1, w)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:m], ahead[w - 1 : w - 1 + m])


def packed48(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, 6 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper 32 bits: sorted hashes come in order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
