"""Rank bitmaps over a pool of vectors: set operations of whole pools as a few machine words.

Per dimension the pool's distinct values are sorted and every rank gets the bitmap of the members up to it.  All
members at or below a point then are the AND of one gathered bitmap per dimension, so a point costs
``dimensions * members / 64`` word operations and no comparison of two vectors.
"""

from __future__ import annotations

import numpy as np

SLICE = 4096  # members of one set of bitmaps: 2 MB per dimension at most


def rank_table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and bitmaps: row ``i`` has the members below the value of rank ``i``."""
    ranks, of = np.unique(values, return_inverse=True)
    table = np.zeros((len(ranks) + 1, -(-len(values) // 64)), np.uint64)
    member = np.arange(len(values))
    np.bitwise_or.at(table, (of.ravel() + 1, member >> 6), np.uint64(1) << (member & 63).astype(np.uint64))
    return ranks, np.bitwise_or.accumulate(table, axis=0, out=table)


def at_most(table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Per value of ``x`` the members whose value is at most that."""
    return table[1][np.searchsorted(table[0], x, side="right")]


def less(table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return table[1][np.searchsorted(table[0], x, side="left")]


def everyone(n: int) -> np.ndarray:
    """The bitmap of ``n`` members."""
    bits = np.zeros(-(-n // 64) * 64, np.uint8)
    bits[:n] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def lowest_member(bits: np.ndarray) -> np.ndarray:
    """Smallest member of every bitmap, -1 for an empty one."""
    if not bits.shape[1]:
        return np.full(len(bits), -1)
    word = (bits != 0).argmax(axis=1)
    value = bits[np.arange(len(bits)), word]
    low = value & (~value + np.uint64(1))
    return np.where(value != 0, word * 64 + np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64), -1)


def strictly_below(points: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Per point the members at or below it on every dimension and below it on one."""
    below = np.broadcast_to(everyone(len(pool)), (len(points), -(-len(pool) // 64))).copy()
    under = np.zeros_like(below)
    for d in range(points.shape[1]):
        table = rank_table(pool[:, d])
        below &= at_most(table, points[:, d])
        under |= less(table, points[:, d])
        if not below.any():
            break
    return below & under


def undominated(points: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Mask of the points that no different pool vector reaches from below."""
    keep = np.ones(len(points), dtype=bool)
    for lo in range(0, len(pool), SLICE):
        left = np.flatnonzero(keep)
        for at in range(0, len(left), 4 * SLICE):
            some = left[at:at + 4 * SLICE]
            keep[some] = ~strictly_below(points[some], pool[lo:lo + SLICE]).any(axis=1)
    return keep


def reach(points: np.ndarray, pool: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Largest value among the pool vectors strictly below each point, -inf without one.

    Members stand in falling order of their values, so the lowest set bit is the answer, and a point that has one
    leaves before the next slice.
    """
    order = np.argsort(-values, kind="stable")
    out = np.full(len(points), -np.inf)
    for lo in range(0, len(order), SLICE):
        part = order[lo:lo + SLICE]
        left = np.flatnonzero(out == -np.inf)
        for at in range(0, len(left), 4 * SLICE):
            some = left[at:at + 4 * SLICE]
            first = lowest_member(strictly_below(points[some], pool[part]))
            out[some] = np.where(first >= 0, values[part][first], -np.inf)
    return out


def free_sets(points: np.ndarray, used: np.ndarray, level: np.ndarray, pool: np.ndarray, first: np.ndarray, last: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(point, set, killed)`` of points against the members with ``first <= level < last``.

    For a member ``x`` of a point's pool, J is the set of its used dimensions on which the point is at or below ``x``.
    Sets are bit masks.  The distinct J that no member holds (a member holds a set if the point is at or above it on
    all of it) come with ``killed`` = False; one more row has all used dimensions and says whether a member holds them.
    """
    n, k = points.shape
    tables = [rank_table(pool[:, d]) for d in range(k)]
    member = at_most(rank_table(first), level) & everyone(len(pool)) & ~at_most(rank_table(last), level)
    whose, sets = [np.arange(n)], [used]
    step = max(1, (1 << 22) // max(1, len(pool)))
    for lo in range(0, n, step):
        some = slice(lo, min(lo + step, n))
        j = np.zeros((some.stop - lo, len(pool)), np.uint64)
        for d in range(k):
            j |= (points[some, d, None] <= pool[None, :, d]).astype(np.uint64) << np.uint64(d)
        j &= used[some, None]
        inside = np.unpackbits(member[some].view(np.uint8), axis=1, bitorder="little")[:, :len(pool)].astype(bool)
        row, _ = np.nonzero(inside)
        found = np.unique(np.stack([row.astype(np.uint64), j[inside]], 1), axis=0)
        whose.append(found[:, 0].astype(np.int64) + lo)
        sets.append(found[:, 1])
    owner, masks = np.concatenate(whose), np.concatenate(sets)
    killed = held(points[owner], masks, member[owner], tables)
    own = np.arange(len(owner)) < n
    keep = own | ~killed
    return owner[keep], masks[keep], (killed & own)[keep]


def held(points: np.ndarray, masks: np.ndarray, member: np.ndarray, tables: list) -> np.ndarray:
    """True where some member of the point's pool is at or below the point on all dimensions of the mask."""
    out = np.zeros(len(points), bool)
    for lo in range(0, len(points), 2 * SLICE):
        some = slice(lo, lo + 2 * SLICE)
        bits = member[some].copy()
        for d, table in enumerate(tables):
            has = (masks[some] >> np.uint64(d)) & np.uint64(1) == 1
            bits[has] &= at_most(table, points[some, d][has])
        out[some] = bits.any(axis=1)
    return out
