"""Balanced self-joins and bounded dominance passes.

A block-pair plan spreads rows over B hash blocks and copies each row once for
every unordered pair of blocks it belongs to.  The pair of blocks is an equi
key, so the planner never needs a cartesian product, no cell grows beyond
(rows / B)^2 and no group of copies lands in one cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bitmaps import reach, undominated

BLOCK_ROWS = 2048
DOMINANCE_ROWS = 4096
STRONGEST = 256
POOL_STEP = 2048
CORNERS = 1024  # regions whose corners meet in one cell
QUANTILES = 256
GUARDS = 12
GUARD_ROWS = 500
WAITING = 20_000  # rows that wait for a pass over a pool


def block_count(rows: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks that bound a cell and also give every core a few cells."""
    by_size = math.ceil(rows / block_rows)
    by_cores = min(math.ceil(math.sqrt(6 * parallelism)), math.ceil(rows / 32))
    return max(1, by_size, by_cores)


def pair_blocks(left: DataFrame, block_by: Column, order_by: Column, blocks: int) -> DataFrame:
    """All unordered pairs of different rows, columns ``a`` and ``b`` (structs).

    ``order_by`` has to differ between any two rows; ``block_by`` is hashed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    base = left.select(
        row.alias("row"),
        order_by.alias("ord"),
        F.pmod(F.xxhash64(block_by), F.lit(blocks)).cast("int").alias("blk"),
    )
    low = base.select(
        F.col("row").alias("a"), F.col("ord").alias("ord_a"), F.col("blk").alias("p"),
        F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("q"),
    )
    high = base.select(
        F.col("row").alias("b"), F.col("ord").alias("ord_b"), F.col("blk").alias("q"),
        F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("p"),
    )
    cells = max(1, min(blocks * (blocks + 1) // 2, 100_000))
    low = low.repartition(cells, "p", "q")
    high = high.repartition(cells, "p", "q")
    cond = (F.col("p") < F.col("q")) | (F.col("ord_a") < F.col("ord_b"))
    return low.join(high, ["p", "q"]).filter(cond).select("a", "b")


# ---------------------------------------------------------------- dominance

def _clean(m: np.ndarray) -> np.ndarray:
    return np.nan_to_num(m, nan=np.inf, posinf=1e300, neginf=-1e300)


def _local_pool(pts: np.ndarray) -> np.ndarray:
    """Indexes of the minimal vectors of one batch."""
    order = np.argsort(_clean(pts).sum(axis=1), kind="stable")
    pool = np.empty((0, pts.shape[1]))
    kept: list[np.ndarray] = []
    for lo in range(0, len(order), POOL_STEP):
        idx = order[lo:lo + POOL_STEP]
        # the smallest sums rule out most points, so the whole pool sees few
        for part in (pool[:STRONGEST], pool[STRONGEST:]):
            if len(part) and len(idx):
                idx = idx[undominated(pts[idx], part)]
        if len(idx):
            idx = idx[undominated(pts[idx], pts[idx])]
            pool = np.vstack([pool, pts[idx]])
            kept.append(idx)
    return np.concatenate(kept) if kept else np.empty(0, dtype=int)


def local_minima(points: DataFrame, dims: list[str], key: str | None = None,
                 pool_rows: int = 50_000) -> DataFrame:
    """Drop rows dominated inside their own task (``dims`` are minimised).

    Works per ``key`` value; a pool that outgrows ``pool_rows`` is handed on as
    it is, so memory is bounded and the later global pass stays exact.
    """
    schema = points.schema

    def run(batches):
        pools: dict = {}
        for pdf in batches:
            for k, part in (pdf.groupby(key, sort=False) if key else [(None, pdf)]):
                yield from pools.setdefault(k, Pool(dims, pool_rows)).add(part)
        for pool in pools.values():
            yield from pool.rest()

    return points.mapInPandas(run, schema=schema)


class Pool:
    """The minimal rows among those added so far.

    A few of them, the *guards*, rule out most new rows by plain comparisons; the others wait until they are worth a pass.
    """

    def __init__(self, dims: list[str], most: int):
        self.dims, self.most, self.parts, self.size, self.guards, self.fresh = dims, most, [], 0, [], GUARD_ROWS

    def add(self, part: pd.DataFrame):
        if self.guards:
            cols = [part[d].to_numpy(dtype=float) for d in self.dims]
            part = part[~ruled_out(cols, self.guards)]
        if len(part):
            self.parts.append(part)
            self.size += len(part)
        if self.size >= self.fresh:
            yield from self._pass()

    def _pass(self):
        rows = pd.concat(self.parts, ignore_index=True)
        m = rows[self.dims].to_numpy(dtype=float)
        kept = _local_pool(m)
        self.guards = _guards(m[kept], m[:: max(1, len(m) // GUARD_ROWS)]) or self.guards
        rows = rows.iloc[kept]
        if len(rows) > self.most:
            yield rows
            rows = rows[:0]
        self.parts, self.size = [rows], len(rows)
        self.fresh = max(2 * self.size, GUARD_ROWS if not self.guards else WAITING)

    def rest(self):
        if self.size:
            yield from self._pass()
            yield from (p for p in self.parts if len(p))


def ruled_out(cols: list[np.ndarray], guards: list[np.ndarray]) -> np.ndarray:
    """Rows that one of the guards reaches from below."""
    out = np.zeros(len(cols[0]), bool)
    for g in guards:
        below, under = np.ones(len(out), bool), np.zeros(len(out), bool)
        for c, x in zip(cols, g, strict=True):
            below &= c >= x
            under |= c > x
        out |= below & under
    return out


def _guards(pool: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Up to ``GUARDS`` pool vectors that rule out most of the rows, one after the other."""
    some = pool[:: max(1, len(pool) // GUARD_ROWS)]
    hit = np.stack([ruled_out(list(rows.T), [g]) for g in some]) if len(some) else np.zeros((0, len(rows)), bool)
    found = []
    while len(found) < GUARDS and hit.any():
        best = int(hit.sum(axis=1).argmax())
        found.append(some[best])
        hit = hit & ~hit[best]
    return found


def z_order(m: np.ndarray, splits: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Z curve: the dimensions' quantile ranks with their bits interleaved, high bits first."""
    z = np.zeros(len(m), np.int64)
    ranks = [np.searchsorted(s, m[:, d], side="left").astype(np.int64) for d, s in enumerate(splits)]
    for b in reversed(range(bits)):
        for r in ranks:
            z = (z << 1) | ((r >> b) & 1)
    return z


def with_regions(points: DataFrame, dims: list[str], key: str | None, rows: int = DOMINANCE_ROWS) -> DataFrame:
    """Add ``_region``: runs of at most ``rows`` neighbours on the Z curve, of one key each (written)."""
    keys = [key] if key else []
    bits = max(1, min(8, 62 // len(dims)))
    steps = [i / 2**bits for i in range(1, 2**bits)][:QUANTILES]
    marks = points.agg(*[F.percentile_approx(d, F.array(*map(F.lit, steps)), F.lit(1000)).alias(d) for d in dims]).first()
    splits = [np.unique(np.array(m or [], float)) for m in marks]

    def place(batches):
        for pdf in batches:
            yield pdf.assign(_z=z_order(pdf[dims].to_numpy(dtype=float), splits, bits))

    def cut(batches):
        task = TaskContext.get()
        at, size, was = (task.partitionId() if task else 0) << 32, 0, None
        for pdf in batches:
            if pdf.empty:
                continue
            of, place = pdf[key].to_numpy() if key else np.zeros(len(pdf)), np.arange(len(pdf))
            new = np.append(was is None or of[0] != was, of[1:] != of[:-1])
            since = place - np.maximum.accumulate(np.where(new, place, -size))  # rows of the key so far
            number = at + np.cumsum(since % rows == 0)
            at, size, was = int(number[-1]), int(since[-1]) + 1, of[-1]
            yield pdf.drop(columns="_z").assign(_region=number)

    placed = points.mapInPandas(place, points.select("*", F.lit(0).cast("long").alias("_z")).schema)
    # the hash divides rows that share a place, so no place is one task
    dealt = placed.repartitionByRange(*keys, "_z", F.xxhash64(*dims)).sortWithinPartitions(*keys, "_z", F.xxhash64(*dims))
    return materialize(dealt.mapInPandas(cut, points.select("*", F.lit(0).cast("long").alias("_region")).schema), "regions")


def region_pairs(points: DataFrame, dims: list[str], key: str | None, value: str | None) -> DataFrame:
    """``(_region, others, known)``: the regions each region has to meet, by their lower and upper corners.

    A region whose lower corner is not at or below another's upper corner reaches none of its points: they never
    meet.  One whose upper corner is below the other's lower corner reaches all of them at once: without ``value``
    the other region is gone, with it ``known`` = the largest such value, and regions that cannot raise it or whose
    points all have no more than it are left out.
    """
    keys = [key] if key else []
    v = F.col(value) if value else F.lit(0.0)
    corners = points.groupBy("_region", *keys).agg(
        F.array(*[F.min(d) for d in dims]).alias("low"), F.array(*[F.max(d) for d in dims]).alias("high"), F.max(v).alias("top"))
    corners = materialize(corners.withColumn("pack", F.pmod(F.xxhash64("_region"), F.lit(max(1, math.ceil(
        points.select("_region").distinct().count() / CORNERS)))).cast("int")), "corners")
    packs = (corners.agg(F.max("pack")).first()[0] or 0) + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))
    mine = corners.withColumns({"other": every, "role": F.lit(0)})
    theirs = corners.withColumnRenamed("pack", "other").withColumns({"pack": every, "role": F.lit(1)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, p = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if c.empty or p.empty:
            return pd.DataFrame({"_region": np.empty(0, np.int64), "others": np.empty(0, object), "known": np.empty(0)})
        box = lambda f, n: np.stack(f[n].to_numpy()).astype(float)
        some = np.ones((len(c), len(p)), bool)
        whole, strict = some.copy(), np.zeros_like(some)
        for d in range(len(dims)):
            some &= box(p, "low")[None, :, d] <= box(c, "high")[:, None, d]
            whole &= box(p, "high")[None, :, d] <= box(c, "low")[:, None, d]
            strict |= box(p, "high")[None, :, d] < box(c, "low")[:, None, d]
        whole &= strict
        top = p["top"].to_numpy(float)
        known = np.where(whole, top[None] if value else np.inf, -np.inf).max(axis=1)
        if value:
            some &= (top[None] > known[:, None]) & (known < c["top"].to_numpy(float))[:, None]
        else:
            some &= ~np.isposinf(known)[:, None]
        ids = p["_region"].to_numpy()
        return pd.DataFrame({"_region": c["_region"].to_numpy(), "others": [ids[r].tolist() for r in some], "known": known})

    met = mine.unionByName(theirs).groupBy("pack", "other", *keys).applyInPandas(meet, "_region long, others array<long>, known double")
    merged = met.groupBy("_region").agg(F.flatten(F.collect_list("others")).alias("others"), F.max("known").alias("known"))
    if not value:  # one pack may rule out what another one kept
        merged = merged.filter("known < double('inf')")
    return materialize(merged, "meetings")


def dominance_cells(points: DataFrame, dims: list[str], key: str | None, rows: int = DOMINANCE_ROWS,
                    value: str | None = None) -> DataFrame:
    """Compare points with all others they can depend on, inside cells of ``rows`` x ``rows`` points at most.

    Without ``value``: the points no other point dominates.  With it: the points with ``reach`` = the largest
    ``value`` among the other points at or below them on ``dims`` (-inf if there is none), of those whose ``reach``
    is below their own value.  Points are distinct on ``dims``.
    """
    cols = list(points.columns)
    if points.count() <= rows:
        near = points.withColumns({"known": F.lit(float("-inf")), "_n": F.lit(1)})
        both = [near.withColumn("_role", F.lit(role)) for role in (0, 1)]
        return _compared(both[0].unionByName(both[1]), [key] if key else ["_n"], cols, dims, points, value)
    placed = with_regions(points, dims, key, rows)
    pairs = region_pairs(placed, dims, key, value)
    cand = (placed.join(pairs, "_region").withColumn("_n", F.size("others"))
            .select(*cols, "known", "_n", F.col("_region").alias("_c"), F.explode("others").alias("_p"), F.lit(0).alias("_role")))
    wanted = pairs.select(F.col("_region").alias("_c"), F.explode("others").alias("_p"))
    pool = placed.join(wanted, F.col("_region") == F.col("_p")).select(
        *cols, F.lit(0.0).alias("known"), F.lit(1).alias("_n"), "_c", "_p", F.lit(1).alias("_role"))
    return _compared(cand.unionByName(pool), ["_c", "_p"], cols, dims, points, value)


def _compared(rows: DataFrame, cell_by: list[str], cols: list[str], dims: list[str], points: DataFrame, value: str | None) -> DataFrame:
    """Candidates (role 0) against the pool (role 1) of each cell; a candidate survives if it does in all its cells."""
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        c, p = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        cm, pm = c[dims].to_numpy(dtype=float), p[dims].to_numpy(dtype=float)
        if value is None:
            return c.loc[undominated(cm, pm), [*cols, "_n"]]
        return c[cols].assign(reach=np.maximum(reach(cm, pm, p[value].to_numpy(dtype=float)), c["known"].to_numpy(float)))

    extra = F.lit(0.0).alias("reach") if value else F.lit(0).alias("_n")
    parts = rows.groupBy(*cell_by).applyInPandas(cell, points.select("*", extra).schema)
    if value is not None:
        return parts.groupBy(*cols).agg(F.max("reach").alias("reach")).filter(F.col("reach") < F.col(value))
    return parts.groupBy(*cols, "_n").agg(F.count("*").alias("_met")).filter("_met = _n").select(*cols)
