"""What discovery needs of all distance vectors, made from the rows without writing a vector.

The coded attribute with most values is the band axis.  A task takes the pairs whose distance on it lies in one band, so
equal vectors always meet in one task, and it takes them in parts of a bounded number of pairs.  The different vectors of
a part are counted by value for the medians and looked up in a table of the minimal points found so far; what that table
rules out is forgotten.  A task holds the rows (as numbers) and one part; it hands on its minimal points and its counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import INF, MICROS_PER_DAY
from ..plans.blocks import GUARD_ROWS, _guards, _local_pool
from ..plans.prefix import exact_medians
from ..session import materialize
from .coded import SLOTS, Axis, Rows, _distinct, _Numbers, _Strings, edit_table

PART = 1 << 21  # pairs of a part
HEAVY = 1 << 24  # pairs of one distance that may be sorted at once
CHUNK = 1 << 16  # pairs whose distances are made at a time
WORD_TABLE = 2048  # words from which edit distances are made pair by pair
LONGEST = 250  # characters of a string
CELLS = 1 << 18  # places of the table of minimal points
RANKS = 1024  # its ranks of one attribute
FRESH = 20_000  # points that wait for a pass
KEPT = 50_000  # minimal points that a task keeps
DENSE = 1 << 22  # values of an attribute that are counted in an array
BINS = 4096
TASK_PAIRS = 1 << 31


def band_cuts(rows: Rows) -> list[tuple[int, int]] | None:
    """Bands of about equally many pairs; None if no number divides the pairs well enough: then one distance has more
    pairs than a task can hold."""
    values, space, by, n = rows.values, rows.space, rows.by, rows.n
    if by is None or n < 2 or any(a.kind == "edit" and a.size > LONGEST for a in space):
        return None
    axis, c = space[by], F.col(f"_{by}")
    known = F.when(~F.isnan(c) & (F.abs(c) < INF), F.rint(c * float(axis.scale))) if axis.kind == "abs" else c
    step = 1 if axis.kind == "abs" else MICROS_PER_DAY
    v = values.select(known.cast("long").alias("v"))
    ends = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    often = v.filter("v IS NOT NULL").groupBy((F.floor(F.col("v") / step) if step > 1 else F.col("v")).alias("v")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rest, odd = math.prod(a.size for a in space) // axis.size, n - ends[2]
    if rest > SLOTS and n * max(often * (1 if step == 1 else 2), odd) > HEAVY:
        return None
    width = (ends[1] - ends[0]) // BINS + 1
    # one number per bin
    bins = v.filter("v IS NOT NULL").groupBy(F.expr(f"(v - {ends[0]}L) div {width}L").alias("b")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(BINS)
    for r in bins:
        counts[r["b"]] = r["n"]
    pairs = np.correlate(counts, counts, "full")[BINS - 1:]
    pairs[0] /= 2
    cores = values.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(max(4 * cores, math.ceil(n * n / 2 / TASK_PAIRS)), math.ceil(n * n / 2 / CHUNK)))
    at = np.interp(np.arange(1, tasks) / tasks * pairs.sum(), np.cumsum(pairs), (np.arange(BINS) + 0.5) * width) / step
    cuts = [0, *sorted({int(x) for x in at if 0 < int(x) < axis.size - 1}), axis.size - 1]
    bands = list(zip(cuts[:-1], cuts[1:], strict=True))
    return [*bands, (axis.size - 1, axis.size)] if odd else bands


# ------------------------------------------------------------------ distances

class _Words:
    """Edit distances of single pairs of rows, as places on the axis."""

    def __init__(self, column: pa.Array, axis: Axis):
        s = _Strings(column, axis)
        self.code, words, self.none = s.code, s.words, axis.size - 1
        self.null, self.table = bool((s.code < 0).any()), None
        if len(words) <= WORD_TABLE:
            self.table = np.full((len(words) + 1, len(words) + 1), self.none, np.int32)  # a null is at place -1
            self.table[:-1, :-1] = edit_table(words, words)
            self.table[-1, -1] = 0
            return
        low, high = words[0], words[-1]
        lead = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        self.size = np.array([len(w) - lead for w in words])
        width = int(self.size.max())
        chars = np.array([w[lead:].ljust(width, "\0") for w in words], f"<U{max(1, width)}").view(np.uint32).reshape(len(words), -1)[:, :width]
        self.chars = np.ascontiguousarray(chars.T, np.uint8 if chars.max(initial=0) < 256 else np.uint32)

    def gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.code[i], self.code[j]
        if self.table is not None:
            return self.table[a, b]
        if not self.null:
            return self._edits(a, b)
        out = np.where(a == b, 0, self.none)
        known = np.flatnonzero((a >= 0) & (b >= 0))
        out[known] = self._edits(a[known], b[known])
        return out

    def _edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of both minus the best score, where a step in one string scores 0, one in both 1 and 2 on equal characters."""
        na, nb = self.size[a], self.size[b]
        wide, deep = int(nb.max(initial=0)), int(na.max(initial=0))
        score = np.zeros(len(a), np.uint16)
        kind = np.uint8 if wide + deep < 256 else np.uint16
        one, two = self.chars[:deep].take(a, axis=1), self.chars[:wide].take(b, axis=1)
        row, new = np.zeros((wide + 1, len(a)), kind), np.zeros((wide + 1, len(a)), kind)
        even = bool(len(a)) and int(nb.min()) == wide and int(na.min()) == deep
        for p in range(deep):
            best = (two == one[p]).astype(kind)
            best += row[:-1]
            best += kind(1)
            np.maximum(best, row[1:], out=best)
            for q in range(wide):
                np.maximum(best[q], new[q], out=new[q + 1])
            row, new = new, row
            if not even:
                ends = np.flatnonzero(na == p + 1)
                score[ends] = row[nb[ends], ends]
        return na + nb - (row[wide] if even and deep else score)


class _Gaps:
    """Distances of a numeric attribute, as places on the axis."""

    def __init__(self, column: pa.Array, axis: Axis):
        self.numbers, self.none = _Numbers(column, axis), axis.size - 1
        self.odd = self.numbers.odd if self.numbers.odd.any() else None

    def gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = self.numbers.value[j]
        d -= self.numbers.value[i]
        np.abs(d, out=d)
        if self.numbers.step != 1:
            d //= self.numbers.step
        if self.odd is not None:
            x, y = self.odd[i], self.odd[j]
            some = np.flatnonzero((x != 0) | (y != 0))
            d = d.astype(np.int64)
            d[some] = np.where(x[some] == y[some], 0, self.none)
        return d


# --------------------------------------------------------------------- points

class Near:
    """Minimal points ``(left.., r)``, r from above; a table of ranks says of most points that one of them rules them out."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.parts, self.size, self.fresh = sizes, [], 0, FRESH
        self.places, self.top, self.most, self.out, self.guards, self.seen = None, None, -1, [], [], None

    def left(self, cols: list[np.ndarray], r: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Those that no minimal point of the table is at or below with as large a right distance.

        One that equals a minimal point goes too: that point is handed on anyway."""
        if self.top is None or not len(some) or r.min() > self.most:
            return some
        if len(some) < len(r):
            cols, r = [c[some] for c in cols], r[some]
        for g in self.guards:  # they rule out most at the price of a few comparisons
            keep = r > -g[-1]
            for c, x in zip(cols, g[:-1], strict=True):
                keep |= c < x
            kept = np.flatnonzero(keep)
            some, r, cols = some[kept], r[kept], [c[kept] for c in cols]
        at = np.zeros(len(some), np.int32)
        for c, place in zip(cols, self.places, strict=True):
            at += place(c)
        return some[r > self.top[at]]

    def add(self, cols: list[np.ndarray], r: np.ndarray, some: np.ndarray | None = None) -> None:
        some = np.arange(len(r)) if some is None else some
        self.seen = np.stack([*[c[some[::len(some) // GUARD_ROWS + 1]] for c in cols], -r[some[::len(some) // GUARD_ROWS + 1]]], 1)
        some = self.left(cols, r, some)
        while len(some) > FRESH:
            few = some[::len(some) // FRESH + 1]
            self._take(cols, r, few)
            self._pass()
            before, some = len(some), self.left(cols, r, some)
            if 2 * len(some) > before:
                for lo in range(0, len(some), FRESH):
                    self._take(cols, r, self.left(cols, r, some[lo:lo + FRESH]))
                    if self.size >= self.fresh:
                        self._pass()
                return
        self._take(cols, r, some)
        if self.size >= self.fresh:
            self._pass()

    def _take(self, cols, r, some) -> None:
        if len(some):
            self.parts.append(np.stack([*[c[some] for c in cols], -r[some]], 1).astype(np.float64))
            self.size += len(some)

    def _pass(self) -> None:
        if not self.size:
            return
        rows = np.concatenate(self.parts)
        rows = np.unique(rows[_local_pool(rows)], axis=0)
        self._table(rows)
        self.guards = [g.astype(np.int64) for g in _guards(rows, self.seen)[:2]]
        if len(rows) > KEPT:
            self.out.append(rows)
            rows = rows[:: len(rows) // (KEPT // 8) + 1]
        self.parts, self.size = [rows], len(rows)
        self.fresh = max(2 * self.size, FRESH)

    def _table(self, rows: np.ndarray) -> None:
        marks = [np.unique(rows[:, d]).astype(np.int64) for d in range(len(self.sizes))]
        room = CELLS
        for done, d in enumerate(sorted(range(len(marks)), key=lambda d: len(marks[d]))):
            most = max(2, min(RANKS, int(room ** (1 / (len(marks) - done)))) - 1)
            if len(marks[d]) > most:
                marks[d] = marks[d][np.linspace(0, len(marks[d]) - 1, most).astype(int)]
            room //= len(marks[d]) + 1
        shape = [len(m) + 1 for m in marks]
        at = np.zeros(len(rows), np.int64)
        seen = np.ones(len(rows), bool)
        for d, m in enumerate(marks):
            place = np.searchsorted(m, rows[:, d], "left") + 1  # the first place whose lower end is not below the point
            seen &= place < shape[d]
            at = at * shape[d] + place
        top = np.full(math.prod(shape), -1, np.int64)
        np.maximum.at(top, at[seen], (-rows[seen, -1]).astype(np.int64))
        top = top.reshape(shape)
        for d in range(len(shape)):
            np.maximum.accumulate(top, axis=d, out=top)
        self.top, self.places, self.most = top.ravel(), [], top.max()
        for d, m in enumerate(marks):
            self.places.append(_place(m, math.prod(shape[d + 1:]), self.sizes[d]))

    def rest(self) -> list[np.ndarray]:
        self._pass()
        out = [*self.out, *self.parts]
        return [x for x in out if len(x)]


def _place(marks: np.ndarray, stride: int, size: int):
    """The rank of a value among the marks, times ``stride``."""
    if size <= DENSE:
        table = np.repeat(np.arange(len(marks) + 1, dtype=np.int32) * np.int32(stride), np.diff(np.concatenate([[0], marks, [size]])))
        return table.take
    return lambda v: (np.searchsorted(marks, v, "right") * stride).astype(np.int32)


class Counts:
    """How often each value of an attribute occurs."""

    def __init__(self, size: int):
        self.whole = np.zeros(size, np.int64) if size <= DENSE else None
        self.values, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, v: np.ndarray) -> None:
        self.waiting.append(v)
        self.size += len(v)
        if self.size >= PART:
            self._count()

    def _count(self) -> None:
        if not self.size:
            return
        v, self.waiting, self.size = np.concatenate(self.waiting), [], 0
        if self.whole is not None:
            low, high = int(v.min()), int(v.max())
            self.whole[low:high + 1] += np.bincount(v - low if low else v, minlength=high - low + 1)
            return
        v, n = np.unique(v, return_counts=True)
        self.values, place = np.unique(np.concatenate([self.values, v]), return_inverse=True)
        self.n = np.bincount(place.ravel(), np.concatenate([self.n, n]), len(self.values)).astype(np.int64)

    def parts(self, bits: int = 16):
        """``(part, values, counts)`` of values that share their high bits."""
        self._count()
        v = np.flatnonzero(self.whole) if self.whole is not None else self.values
        n = self.whole[v] if self.whole is not None else self.n
        starts = np.flatnonzero(np.append(True, v[1:] >> bits != v[:-1] >> bits)) if len(v) else []
        for lo, hi in zip(starts, [*starts[1:], len(v)], strict=True):
            yield int(v[lo] >> bits), v[lo:hi], n[lo:hi]


def in_values(v: np.ndarray, axis: Axis) -> np.ndarray:
    """Places on an axis as distances."""
    d = v.astype(np.float64)
    if axis.unit is not None:
        d = d * (axis.unit / axis.scale) / axis.unit
    d[v == axis.size - 1] = INF
    return d


# ---------------------------------------------------------------------- bands

class _Band:
    """The pairs of one band; rows stand by what kind of number they have on the band axis and by that number."""

    def __init__(self, t: pa.Table, space: list[Axis], by: int):
        first = _Numbers(column_of(t, by), space[by])
        order = np.lexsort((first.value, first.odd))
        self.value, odd, self.step = first.value[order].astype(np.int64), first.odd[order], first.step
        self.n, self.known, self.far = len(order), int((odd == 0).sum()), space[by].size - 1
        self.end = np.searchsorted(odd, odd, "right")  # the end of the rows of the same kind
        t = t.take(pa.array(order))
        self.others = [i for i in range(len(space)) if i != by]
        self.data = [(_Words if space[i].kind == "edit" else _Gaps)(column_of(t, i), space[i]) for i in self.others]
        self.sizes = [space[i].size for i in self.others]
        self.rest, self.by, self.k = math.prod(self.sizes), by, len(space)

    def beyond(self, distance: int) -> np.ndarray:
        """Per row with a number the first later one at that distance or more."""
        v = self.value[:self.known]
        found = np.searchsorted(v, v + distance * self.step, "left")
        return np.maximum(found, np.arange(1, self.known + 1))

    def partners(self, lo: int, hi: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per row the range of rows that it meets at distances from ``lo`` up to ``hi``."""
        if lo == self.far:
            return self.end.copy(), np.full(self.n, self.n)
        first, last = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        first[:self.known] = self.beyond(lo) if start is None else start
        last[:self.known] = self.beyond(hi)
        if lo == 0:  # rows without a number are at 0 from those of their kind
            first[self.known:], last[self.known:] = np.arange(self.known + 1, self.n + 1), self.end[self.known:]
        return first, last

    def slots(self, lo: int, first: np.ndarray, last: np.ndarray):
        """The vectors of the pairs, chunk by chunk, as numbers in which the band axis counts from ``lo``."""
        upto = np.cumsum(last - first)
        total = int(upto[-1])
        for at in range(0, total, CHUNK):
            stop = min(at + CHUNK, total)
            a, b = int(np.searchsorted(upto, at, "right")), int(np.searchsorted(upto, stop, "left")) + 1
            begin = upto[a:b] - (last[a:b] - first[a:b])
            n = np.minimum(upto[a:b], stop) - np.maximum(begin, at)
            i = np.repeat(np.arange(a, b), n)
            j = np.arange(at, stop)
            j += np.repeat(first[a:b] - begin, n)
            if lo == self.far:
                out = np.zeros(len(i), np.int64)
            else:
                out = self.value[j]
                out -= self.value[i]
                if self.step != 1:
                    out //= self.step
                out -= lo
                if lo == 0:
                    out[i >= self.known] = 0
            for d, s in zip(self.data, self.sizes, strict=True):
                out *= s
                out += d.gaps(i, j)
            yield out

    def parts(self, lo: int, hi: int, zero: bool):
        """``(from, slots)``: the different vectors of one part of the band after the other."""
        first, last = self.partners(lo, hi)
        density = max(1.0, float((last - first).sum()) / (hi - lo))
        room = max(1, SLOTS // self.rest)
        width, at, start = min(hi - lo, room if 16 * density >= self.rest else max(1, int(PART / density))), lo, None
        while at < hi:
            stop = min(hi, at + width)
            first, last = self.partners(at, stop, start)
            total = int((last - first).sum())
            space = (stop - at) * self.rest
            marked = space <= min(SLOTS, 16 * max(total, PART // 64)) or (total > HEAVY and space <= SLOTS)
            if not marked and total > 2 * PART and width > 1:
                width = max(1, min(width // 2, int(width * PART / total)))
                continue
            if marked:
                seen = np.zeros(space, bool)
                seen[:1] = zero and at == 0
                for s in self.slots(at, first, last):
                    seen[s] = True
                found = np.flatnonzero(seen)
                del seen
            else:
                found = np.empty(total + 1, np.int64)
                size = 0
                for s in self.slots(at, first, last):
                    found[size:size + len(s)] = s
                    size += len(s)
                if zero and at == 0:
                    found[size] = 0
                    size += 1
                found = _distinct(found[:size])
            yield at, found
            if not marked and total < PART // 2:
                width = max(width + 1, min(2 * width, int(width * PART / max(1, total))))
            start = last[:self.known] if at != self.far else None
            at = stop

    def places(self, at: int, slots: np.ndarray) -> list[np.ndarray]:
        """Per attribute the place on its axis."""
        out: list = [None] * self.k
        for i, s in zip(reversed(self.others), reversed(self.sizes), strict=True):
            q = slots // s
            out[i] = slots - q * s
            slots = q
        out[self.by] = slots + at
        return out


def column_of(t: pa.Table, i: int) -> pa.Array:
    return t.column(f"_{i}").combine_chunks()


def band_result(t: pa.Table, space: list[Axis], by: int, band: tuple[int, int], zero: bool, sides: list[tuple[int, list[int]]],
                count: bool, split_whole: bool) -> pa.Table:
    """The minimal points of every side and the counts of every attribute in one band.

    ``split_whole``: whole right distances also rule each other out apart from the others, as it is not known yet which
    others will be used.  A fractional one in use that rules out another has an at least as large right distance, so both
    are in use.
    """
    rows = _Band(t.combine_chunks(), space, by)
    near = [Near([space[c].size for c in left]) for _, left in sides]
    whole = {s: Near([space[c].size for c in left]) for s, (r, left) in enumerate(sides) if split_whole and space[r].scale > 1}
    counts = [Counts(a.size) for a in space] if count else []

    def points(v: list[np.ndarray]) -> None:
        for s, (r, left) in enumerate(sides):
            cols = [v[c] for c in left]
            near[s].add(cols, v[r])
            if s in whole:
                whole[s].add(cols, v[r], np.flatnonzero((v[r] % space[r].scale == 0) | (v[r] == space[r].size - 1)))

    first = True
    for at, slots in rows.parts(*band, zero):
        if first and len(slots) > CHUNK:  # the first points are from the whole part
            points(rows.places(at, slots[::len(slots) // CHUNK + 1]))
        first &= not len(slots)
        for x in reversed(range(0, len(slots), CHUNK)):  # right distances on the band axis fall
            v = rows.places(at, slots[x:x + CHUNK])
            for c, y in zip(counts, v, strict=False):
                c.add(y)
            points(v)
    k = len(sides[0][1])
    parts = []
    for s, pool in [*enumerate(near), *whole.items()]:
        r, left = sides[s]
        for p in pool.rest():
            cols = [in_values(p[:, d].astype(np.int64), space[c]) for d, c in enumerate(left)]
            parts.append(_rows(k, len(p), side=np.full(len(p), s, np.int32), cols=cols, r=in_values((-p[:, -1]).astype(np.int64), space[r])))
    for a, c in enumerate(counts):
        some = list(c.parts())
        parts.append(_rows(k, len(some), attr=[a] * len(some), part=[x[0] for x in some],
                           counts=[np.stack(x[1:]).astype("<i8").tobytes() for x in some]))
    return pa.concat_tables(parts or [_rows(k, 0)])


def _rows(k: int, n: int, side=None, cols=None, r=None, attr=None, part=None, counts=None) -> pa.Table:
    made = lambda x, kind: pa.array([None] * n if x is None else x, kind)
    return pa.table({"side": made(side, pa.int32()), **{f"v{d}": made(cols and cols[d], pa.float64()) for d in range(k)},
                     "r": made(r, pa.float64()), "attr": made(attr, pa.int32()), "part": made(part, pa.int64()), "counts": made(counts, pa.binary())})


def banded(rows: Rows, cuts: list[tuple[int, int]], sides: list[tuple[str, list[str]]], count: bool,
           split_whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(side, v0.., r)``: points that no point of their task rules out; and ``(attr, median)`` if ``count``."""
    names, space, by, zero, spark = rows.attrs, rows.space, rows.by, rows.zero, rows.values.sparkSession
    places = [(names.index(r), [names.index(c) for c in left]) for r, left in sides]
    k, tasks = len(sides[0][1]), len(cuts)
    # one key per partition, so that no task gets two bands
    keys = spark.range(64 * tasks + 64).selectExpr("cast(id AS int) AS key", f"pmod(hash(cast(id AS int)), {tasks}) AS part").groupBy("part").agg(F.min("key").alias("key"))
    keys = [r["key"] for r in keys.orderBy("part").collect()]
    keys += [10**6 + i for i in range(tasks - len(keys))]
    bands = dict(zip(keys, cuts, strict=True))
    every = rows.values.withColumn("_t", F.explode(F.array(*map(F.lit, keys)))).repartition(tasks, "_t")

    def run(key, t):
        return band_result(t, space, by, bands[key[0].as_py()], zero, places, count, split_whole)

    kind = ", ".join(["side int", *[f"v{d} double" for d in range(k)], "r double, attr int, part long, counts binary"])
    made = materialize(every.groupBy("_t").applyInArrow(run, kind), "bands")
    points = made.filter("side IS NOT NULL").select("side", *[f"v{d}" for d in range(k)], "r")
    if not count:
        return points, None

    def summed(t):
        a = t.column("attr")[0].as_py()
        every = [np.frombuffer(b, "<i8").reshape(2, -1) for b in t.column("counts").to_pylist()]
        low, high = min(int(x[0, 0]) for x in every), max(int(x[0, -1]) for x in every)
        total = np.zeros(high - low + 1, np.int64)
        for v, n in every:
            total[v - low] += n
        v = np.flatnonzero(total)
        return pa.table({"attr": pa.array([names[a]] * len(v), pa.string()), "part": pa.array(np.zeros(len(v), np.int32)),
                         "value": pa.array(in_values(v + low, space[a])), "cnt": pa.array(total[v])})

    hist = made.filter("attr IS NOT NULL").groupBy("attr", "part").applyInArrow(summed, "attr string, part int, value double, cnt long")
    return points, exact_medians(materialize(hist, "hist"))
