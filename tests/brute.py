"""Plain Python versions of the operators for small inputs."""

import itertools
import math

INF = math.inf


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def gap(a, b):
    if a is None and b is None:
        return 0.0
    if a is None or b is None:
        return INF
    if isinstance(a, str):
        return float(edit(a, b))
    return round(abs(float(a) - float(b)), 6)


def vectors(rows, metric=None):
    metric = metric or {}
    out = set()
    for a, b in itertools.combinations(rows, 2):
        out.add(tuple(metric.get(i, gap)(x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))))
    return out


def median(values):
    v = sorted(values)
    n = len(v)
    return (v[(n - 1) // 2] + v[n // 2]) / 2


def minimal(points):
    return {p for p in points
            if not any(q != p and all(a <= b for a, b in zip(q, p, strict=True)) for q in points)}


def holds(vecs, rhs, beta, lhs):
    """lhs: {position: threshold}"""
    return all(v[rhs] <= beta for v in vecs if all(v[i] <= t for i, t in lhs.items()))


def discover(vecs, rhs, compat=False):
    """Level by level search; returns a set of (beta, lhs thresholds or None)."""
    vecs = list(vecs)
    k = len(vecs[0])
    left = [i for i in range(k) if i != rhs]
    med = [median([v[i] for v in vecs]) for i in range(k)]
    if compat:
        vecs = [v for v in vecs if v[rhs] > med[rhs] or v[rhs] == math.floor(v[rhs])]
    found = set()
    for beta in sorted({v[rhs] for v in vecs if v[rhs] <= med[rhs]}, reverse=True):
        lv = lambda keep: {tuple(v[i] for i in left) for v in vecs if keep(v)}
        pool = minimal(lv(lambda v: v[rhs] > beta))
        cand = {p for p in minimal(lv(lambda v: v[rhs] >= beta)) - pool
                if p in lv(lambda v: v[rhs] == beta)}
        if not cand:
            continue
        mu = [min((p[i] for p in pool), default=INF) for i in range(k - 1)]
        cut = {p: [x if x <= med[left[i]] else None for i, x in enumerate(p)] for p in cand}
        best = [min((c[i] for c in cut.values() if c[i] is not None), default=None) for i in range(k - 1)]
        imp = [best[i] is not None and best[i] < mu[i] for i in range(k - 1)]
        for i in range(k - 1):
            if imp[i]:
                found.add((beta, tuple(best[i] if j == i else None for j in range(k - 1))))
        for p, c in cut.items():
            m = {i for i in range(k - 1) if imp[i] and c[i] == best[i]}
            used = [i for i in range(k - 1) if i not in m]
            if len(used) <= 1:
                continue
            if m and any(all(p[i] >= x[i] for i in used) for x in pool):
                continue
            any_out = False
            for x in pool:
                js = [i for i in used if p[i] <= x[i]]
                if not any(y != x and all(p[i] >= y[i] for i in js) for y in pool):
                    found.add((beta, tuple(p[i] if i in js else None for i in range(k - 1))))
                    any_out = True
            if not any_out:
                found.add((beta, tuple(p[i] if i in used else None for i in range(k - 1))))
    return found


def max_clique(weights, edges):
    """Largest total weight, smallest id list on ties (exponential)."""
    ids = sorted(weights)
    adj = {frozenset(e) for e in edges}
    best = (0, [])
    for r in range(1, len(ids) + 1):
        for combo in itertools.combinations(ids, r):
            if all(frozenset(p) in adj for p in itertools.combinations(combo, 2)):
                w = sum(weights[i] for i in combo)
                if w > best[0] or (w == best[0] and list(combo) < best[1]):
                    best = (w, list(combo))
    return best
