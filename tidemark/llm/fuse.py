"""Static binary-fuse filters with 8-bit fingerprints over sets of 64-bit keys.

The construction follows the published three-wise binary fuse filter: every key
owns one slot in each of three consecutive segments, keys are peeled off slots
they own alone, and fingerprints are assigned in reverse order.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        for factor in _MIX:
            h = (h ^ (h >> np.uint64(33))) * factor
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    n = max(n, 2)
    segment = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return segment, max(1, -(-int(round(n * factor)) // segment) - 2)


def build(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, fingerprints) of a non-empty set of distinct uint64 keys."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    segment, count = _shape(len(keys))
    size = (count + 2) * segment
    index = np.arange(len(keys), dtype=np.float64)
    for seed in range(1, 1000):
        h = _hash(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = _slots(h, segment, count)
        owners = np.bincount(slots.ravel(), minlength=size)
        sums = np.bincount(slots.ravel(), weights=np.tile(index, 3), minlength=size)
        order, left = [], len(keys)
        while left:
            alone = np.flatnonzero(owners == 1)
            if not len(alone):
                break
            peeled, at = np.unique(sums[alone].astype(np.int64), return_index=True)
            order.append((peeled, alone[at]))
            gone = slots[:, peeled].ravel()
            owners -= np.bincount(gone, minlength=size)
            sums -= np.bincount(gone, weights=np.tile(peeled.astype(np.float64), 3), minlength=size)
            left -= len(peeled)
        if left:
            continue
        prints, wanted = np.zeros(size, dtype=np.uint8), _fingerprint(h)
        for peeled, slot in reversed(order):
            s = slots[:, peeled]
            prints[slot] = 0
            prints[slot] = wanted[peeled] ^ prints[s[0]] ^ prints[s[1]] ^ prints[s[2]]
        return seed, segment, prints.tobytes()
    raise ValueError("no seed gives a filter")


def contains(keys: np.ndarray, seed: int, segment: int, prints: bytes) -> np.ndarray:
    """Whether each key may be in the set; never false for a member."""
    table = np.frombuffer(prints, dtype=np.uint8)
    h = _hash(np.asarray(keys, dtype=np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    s = _slots(h, segment, len(table) // segment - 2)
    return _fingerprint(h) == table[s[0]] ^ table[s[1]] ^ table[s[2]]
