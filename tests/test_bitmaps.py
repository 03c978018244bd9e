"""Rank bitmaps, regions and pool sets against plain comparisons."""

import random

import numpy as np
import pytest

from nearfd.plans import bitmaps as B


def grid(rng, n, k, top):
    m = rng.integers(0, top, (n, k)).astype(float)
    m[rng.random((n, k)) < 0.05] = np.inf
    return m


def plain_below(points, pool):
    le = (pool[None] <= points[:, None]).all(2)
    return le & (pool[None] < points[:, None]).any(2)


@pytest.mark.parametrize("n,m,k,top", [(50, 70, 3, 5), (1, 1, 1, 2), (40, 0, 2, 3), (0, 20, 2, 3), (300, 129, 6, 9), (64, 64, 2, 4)])
def test_members_below(n, m, k, top):
    rng = np.random.default_rng(n + m)
    points, pool = grid(rng, n, k, top), grid(rng, m, k, top)
    want = plain_below(points, pool)
    bits = B.strictly_below(points, pool)
    got = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool) if n else want
    assert (got == want).all()
    assert (B.undominated(points, pool) == ~want.any(1)).all()
    values = rng.integers(0, 30, m).astype(float)
    assert (B.reach(points, pool, values) == np.where(want, values[None], -np.inf).max(1, initial=-np.inf)).all()


def test_pools_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(B, "SLICE", 64)
    rng = np.random.default_rng(4)
    points, pool = grid(rng, 700, 4, 12), grid(rng, 500, 4, 12)
    want, values = plain_below(points, pool), rng.random(500)
    assert (B.undominated(points, pool) == ~want.any(1)).all()
    assert (B.reach(points, pool, values) == np.where(want, values[None], -np.inf).max(1)).all()


def test_free_sets_equal_plain_sets():
    rng = np.random.default_rng(8)
    for k in (2, 3, 5, 40):
        points, pool = rng.integers(0, 4, (60, k)).astype(float), rng.integers(0, 4, (90, k)).astype(float)
        level, first = rng.integers(0, 6, 60).astype(float), rng.integers(0, 5, 90).astype(float)
        last = first + rng.integers(1, 4, 90)
        used = np.array([random.Random(i).getrandbits(k) for i in range(60)], np.uint64)
        owner, masks, killed = B.free_sets(points, used, level, pool, first, last)
        got = {(int(o), int(m), bool(x)) for o, m, x in zip(owner[60:], masks[60:], killed[60:])}
        want, stopped = set(), []
        for i in range(60):
            mine = [x for x, a, b in zip(pool, first, last) if a <= level[i] < b]
            u = int(used[i])
            js = {sum(1 << d for d in range(k) if u >> d & 1 and points[i][d] <= x[d]) for x in mine}
            ds = [sum(1 << d for d in range(k) if u >> d & 1 and points[i][d] >= x[d]) for x in mine]
            want |= {(i, j, False) for j in js if not any(j & d == j for d in ds)}
            stopped.append(any(u & d == u for d in ds))
        assert got == want and [bool(x) for x in killed[:60]] == stopped and owner[:60].tolist() == list(range(60))


def test_lowest_member():
    bits = np.zeros((4, 3), np.uint64)
    bits[1, 0], bits[2, 1], bits[3, 2] = 1 << 63, 6, 1
    assert B.lowest_member(bits).tolist() == [-1, 63, 65, 128]
