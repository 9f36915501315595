"""Minimal perfect hashing of 64-bit keys (hash and displace).

n keys go to buckets of about four; buckets, largest first, each get the smallest seed that sends
their keys to free cells of a table of exactly n. A look-up is one hash, one seed, one cell. The
keys are not stored: a cell keeps a fingerprint, so a key that was never put in is told with a
chance of 1 - 2**-32.
"""

import numpy as np

from .words import mix

PER_BUCKET = 4


def _cells(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h ^ mix(seed.astype(np.uint64) + np.uint64(0x51ED27))) % np.uint64(n)).astype(np.int64)


def _hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ mix(np.full(1, salt + 77, np.uint64)))


def build(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(salt, a seed for each bucket) of distinct int64 keys."""
    n = len(keys)
    for salt in range(64):
        seeds = _try(_hashed(keys, salt), n)
        if seeds is not None:
            return salt, seeds
    raise ValueError("keys are not distinct")


def _try(h: np.ndarray, n: int) -> np.ndarray | None:
    """All buckets of one size at a time: each tries seed after seed, and where two claim a cell the first has it."""
    buckets = max(1, -(-n // PER_BUCKET))
    of = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of.astype(np.int64), minlength=buckets)
    start = np.cumsum(size) - size
    seeds, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    for s in range(int(size.max(initial=0)), 0, -1):
        open_ = np.flatnonzero(size == s)
        keys = h[order[start[open_][:, None] + np.arange(s)]]
        seed = 0
        while len(open_):
            if s == 1 and seed >= 64:  # single keys: any free cell does, told by the cell itself
                free = np.flatnonzero(~taken)[: len(open_)]
                seeds[open_] = free.astype(np.uint32) | np.uint32(1 << 31)
                taken[free] = True
                break
            if seed > 1 << 20:
                return None
            cells = _cells(keys, np.full(1, seed), n)
            flat = np.sort(cells, 1)
            good = ~taken[cells].any(1) & (flat[:, 1:] != flat[:, :-1]).all(1)
            rows = np.flatnonzero(good)
            first = np.full(n, -1, np.int64) if len(rows) * s > n // 8 else None
            if first is not None:
                first[cells[rows[::-1]].T] = rows[::-1]
                rows = rows[(first[cells[rows]] == rows[:, None]).all(1)]
            else:
                own, used = [], set()
                for r in rows:
                    c = cells[r].tolist()
                    if used.isdisjoint(c):
                        used.update(c)
                        own.append(r)
                rows = np.asarray(own, np.int64)
            taken[cells[rows]] = True
            seeds[open_[rows]] = seed
            left = np.ones(len(open_), bool)
            left[rows] = False
            open_, keys, seed = open_[left], keys[left], seed + 1
    return seeds


def find(keys: np.ndarray, salt: int, seeds: np.ndarray, n: int) -> np.ndarray:
    """The cell of each key, in 0..n-1 (anything there for keys that were never put in)."""
    if n == 0 or not len(keys):
        return np.zeros(len(keys), np.int64)
    h = _hashed(keys, salt)
    seed = seeds[((h >> np.uint64(32)) % np.uint64(len(seeds))).astype(np.int64)]
    direct = seed >> np.uint32(31) == 1
    return np.where(direct, (seed & np.uint32((1 << 31) - 1)).astype(np.int64), _cells(h, seed, n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(13)) >> np.uint64(32)).astype(np.uint32)
