"""Banded alignment of word sequences, and mixing of 64-bit hashes, in numpy. Runs inside tasks."""

from __future__ import annotations

import numpy as np

BLOCK = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; of the whole, if it is shorter but not empty."""
    values = values.astype(np.int64).view(np.uint64)
    size = min(size, len(values))
    if size == 0:
        return np.zeros(0, np.uint64)
    n = len(values) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out + values[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """Hashes with their occurrence number worked in: the n-th of equal hashes gets a value of its own."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(found)]
    if fresh.all():
        return found
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    number = np.empty(len(found), np.uint64)
    number[order] = (np.arange(len(ranked)) - first).astype(np.uint64)
    return np.where(number > 0, mixed(found + number * np.uint64(0xD1B54A32D192ED03)), found)


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the two bags' intersection."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance in words if it is at most ``most``, else None.

    Furthest points are kept for the diagonals of the band that ``most`` edits can reach, one edit
    at a time; runs of equal words are followed in blocks for all diagonals at once.
    """
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[:short] != b[:short])
    head = int(unequal[0]) if len(unequal) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[len(a) - short :] != b[len(b) - short :])
    cut = short - 1 - int(unequal[-1]) if len(unequal) else short
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    if max(n, m) - shared_words(a, b) > most:
        return None
    # Behind the ends, and before the starts, lie values that equal nothing.
    pa = np.concatenate([a, np.full(BLOCK + 1, -(1 << 40))])
    pb = np.concatenate([b, np.full(BLOCK + 1, -(1 << 41))])
    steps = np.arange(BLOCK)
    goal = m - n

    def follow(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((x >= 0) & (x < n) & (x + k >= 0) & (x + k < m))
        while len(live):
            i, j = x[live], x[live] + k[live]
            same = pa[np.minimum(i, n)[:, None] + steps] == pb[np.minimum(j, m)[:, None] + steps]
            run = np.where(same.all(axis=1), BLOCK, same.argmin(axis=1))
            x[live] += run
            live = live[run == BLOCK]
        return x

    reach = follow(np.zeros(1, np.int64), np.zeros(1, np.int64))
    if goal == 0 and reach[0] >= n:
        return 0
    for e in range(1, most + 1):
        k = np.arange(-e, e + 1)
        old = np.full(2 * e + 3, -(1 << 30))
        old[2:-2] = reach
        x = np.maximum(np.maximum(old[1:-1] + 1, old[:-2]), old[2:] + 1)
        x = np.minimum(np.minimum(x, n), m - k)
        reach = follow(x, k)
        if abs(goal) <= e and reach[goal + e] >= n:
            return e
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least ``least``."""
    longer = max(len(a), len(b))
    return distance(a, b, int((1 - least) * longer + 1e-9)) is not None
