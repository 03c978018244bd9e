"""Discovery of relaxed functional dependencies from pair distances.

All right sides are processed in one plan.  A *point* is one distinct left-side
distance vector with its largest right-side distance.  A point p is relevant iff
no point at or below it has an equal or larger right distance; with ``reach`` =
the largest right distance at or below p it belongs to the pool of every level
in ``[reach, r)``.  Pools are therefore intervals and need no sequential loop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..plans.bitmaps import SLICE, at_most, everyone, free_sets, held, rank_table
from ..plans.blocks import DOMINANCE_ROWS, WAITING, Pool, dominance_cells, local_minima
from ..plans.prefix import minima_above, range_splits, with_buckets
from ..session import Later, is_stored, materialize
from .bands import band_cuts, banded
from .pairs import Sides, distance_medians, pair_distances, side_combinations, split_sides
from .rfd import make_rfds

CELL = 4096  # candidates and pool vectors of one cell
POOL_ROWS = 50_000  # minimal points of one side that a task keeps
SMALL = 20_000  # relevant points that one bucket can hold


# Expressions are written as SQL text here: one text is one call into the JVM,
# while the same tree built from Column objects takes hundreds.

def _dims(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _width(sides: Sides) -> int:
    return max(len(left) for _, left in sides)


def rfd_points(pairs: DataFrame, sides: Sides, medians: dict[str, float] | None = None,
               compat_int_rhs: bool = False) -> DataFrame:
    """``(side, v0.., r)``: per left vector the largest right distance.

    Shorter left sides are padded with 0, which never affects dominance.
    """
    dims = _dims(_width(sides))
    rows = []
    for i, (rhs, left) in enumerate(sides):
        values = [_q(c) for c in left] + ["0.0D"] * (len(dims) - len(left))
        fields = ", ".join(f"'{d}', {v}" for d, v in zip(dims, values, strict=True))
        rows.append(f"named_struct('side', {i}, {fields}, 'r', {_q(rhs)})")
    points = pairs.selectExpr(f"inline(array({', '.join(rows)}))")
    if compat_int_rhs:
        limit = _per_side([medians[rhs] for rhs, _ in sides])
        points = points.filter(f"r > {limit} OR r = floor(r)")
    return points.groupBy("side", *dims).agg(F.max("r").alias("r"))


def near_points(pairs: DataFrame, sides: Sides, medians: dict[str, float] | None = None,
                compat_int_rhs: bool = False) -> DataFrame:
    """The points of ``rfd_points`` that no point of their task rules out: all that ``rfd_intervals`` keeps.

    A task makes the points of every side from its pairs and hands on the minimal ones, so the pairs are not shuffled.
    """
    columns, dims = list(pairs.columns), _dims(_width(sides))
    places = [(columns.index(rhs), [columns.index(c) for c in left]) for rhs, left in sides]
    limits = [medians[rhs] for rhs, _ in sides] if compat_int_rhs else None
    names = [*dims, "neg"]

    def run(batches):
        pools, waiting, size = [Pool(names, POOL_ROWS) for _ in places], [], 0

        def made(m: list[np.ndarray]):
            for side, (r, left) in enumerate(places):
                cols = [m[c] for c in left] + [np.zeros(len(m[r]))] * (len(dims) - len(left)) + [-m[r]]
                if limits is not None and limits[side] is not None:
                    use = (m[r] > limits[side]) | (m[r] == np.floor(m[r]))
                    cols = [c[use] for c in cols]
                elif limits is not None:
                    use = m[r] == np.floor(m[r])
                    cols = [c[use] for c in cols]
                yield from named(side, pools[side].add(pd.DataFrame(dict(zip(names, cols, strict=True)))))

        def named(side: int, parts):
            for p in parts:
                yield p.assign(side=np.int32(side), r=-p["neg"])[["side", *dims, "r"]]

        for b in batches:
            waiting.append([b[c].to_numpy(dtype=float) for c in columns])
            size += len(b)
            if size >= WAITING:
                yield from made([np.concatenate(c) for c in zip(*waiting, strict=True)])
                waiting, size = [], 0
        if waiting:
            yield from made([np.concatenate(c) for c in zip(*waiting, strict=True)])
        for side, pool in enumerate(pools):
            yield from named(side, pool.rest())

    kind = ", ".join(["side int", *[f"{d} double" for d in dims], "r double"])
    return pairs.mapInPandas(run, kind).groupBy("side", *dims).agg(F.max("r").alias("r"))


def _medians_and_points(pairs: DataFrame, sides: Sides, medians: DataFrame | None, compat_int_rhs: bool) -> tuple[dict[str, float], DataFrame]:
    """Vectors that are not written yet stay so if the rows can be taken band by band."""
    rows = pairs.source() if isinstance(pairs, Later) and not pairs.is_made() else None
    cuts = band_cuts(rows) if rows is not None else None
    if cuts is None:
        med = _median_map(medians if medians is not None else distance_medians(pairs))
        return med, near_points(pairs, sides, med, compat_int_rhs)
    points, counted = banded(rows, cuts, sides, medians is None, compat_int_rhs)
    med = _median_map(counted if medians is None else medians)
    if compat_int_rhs:
        points = points.filter(f"r > {_per_side([med[rhs] for rhs, _ in sides])} OR r = floor(r)")
    return med, points.groupBy("side", *_dims(_width(sides))).agg(F.max("r").alias("r"))


def rfd_intervals(points: DataFrame) -> DataFrame:
    """Relevant points with ``reach``; each is in the pool of levels [reach, r)."""
    dims = [c for c in points.columns if c.startswith("v")]
    local = local_minima(points.withColumn("neg", -F.col("r")), [*dims, "neg"], "side").drop("neg")
    near = materialize(local, "points")
    return dominance_cells(near, dims, "side", DOMINANCE_ROWS, value="r")


def _median_map(medians: DataFrame) -> dict[str, float]:
    """One number per attribute."""
    return {r["attr"]: r["median"] for r in medians.collect()}


def _number(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"double('{float(v)!r}')"


def _per_side(values: list[float | None]) -> str:
    """The constant of the row's side."""
    return f"element_at(array({', '.join(map(_number, values))}), side + 1)"


def level_splits(intervals: DataFrame) -> DataFrame | None:
    """Level ranges per side, or None while all points fit one small bucket."""
    if intervals.count() <= SMALL:
        return None
    return materialize(range_splits(intervals, "side", "r"), "splits")


def rfd_minima(intervals: DataFrame, medians: dict[str, float], sides: Sides,
               splits: DataFrame | None = None) -> DataFrame:
    """Per side and level: what the level's best values are and which improve.

    ``a{i}`` is the level's minimum when it is at most the median and below every
    minimum of the levels above, else NULL.
    """
    k = _width(sides)
    mins = minima_above(intervals, "side", "r", _dims(k), splits)
    out = mins.filter(f"r <= {_per_side([medians[rhs] for rhs, _ in sides])}")
    best = []
    for i in range(k):
        limit = _per_side([medians[left[i]] if i < len(left) else -1.0 for _, left in sides])
        best.append(f"CASE WHEN min_v{i} <= {limit} AND min_v{i} < above_v{i} THEN min_v{i} END AS a{i}")
    return out.selectExpr("side", "r", *best)


def _single(minima: DataFrame, k: int) -> DataFrame:
    rows = []
    for j in range(k):
        fields = [f"'t{i}', {f'a{i}' if i == j else 'CAST(NULL AS DOUBLE)'}" for i in range(k)]
        rows.append(f"named_struct({', '.join(fields)})")
    out = minima.selectExpr("side", "r", f"inline(array({', '.join(rows)}))")
    return out.filter(f"coalesce({', '.join(f't{i}' for i in range(k))}) IS NOT NULL")


def _bits(flags: list[str]) -> str:
    return " + ".join(f"CASE WHEN {flag} THEN {1 << i}L ELSE 0L END" for i, flag in enumerate(flags))


def _sizes(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("side", "bucket").agg(F.count("*").alias(name))


def _multi(intervals: DataFrame, minima: DataFrame, sides: Sides,
           splits: DataFrame | None = None) -> DataFrame:
    """Dependencies with several left attributes.

    A candidate keeps as used attributes those where it is not its level's
    improving minimum.  For each pool vector x two bit sets matter: J(x), the used
    attributes on which the candidate is at or below x, and D(x), those on which
    it is at or above.  J is emitted iff it is not contained in the D of any pool
    vector.  Candidates and pool meet in cells of ``CELL`` x ``CELL`` at most, where
    rank bitmaps answer which sets a pool vector holds; sets that survive one piece
    of a pool are tested against its other pieces.
    """
    k = _width(sides)
    dims = _dims(k)
    width = f"element_at(array({', '.join(str(len(left)) for _, left in sides)}), side + 1)"
    used = _bits([f"{i} < {width} AND NOT coalesce(v{i} = a{i}, FALSE)" for i in range(k)])
    cand = (intervals.join(minima, ["side", "r"]).selectExpr("side", "r", f"{used} AS used", *dims)
            .selectExpr("*", f"bit_count(used) = {width} AS full").filter("bit_count(used) >= 2"))
    y = with_buckets(cand, "side", splits, bucket="r")
    x = (with_buckets(intervals, "side", splits, first="reach", last="r")
         .selectExpr("side", "explode(sequence(first, last)) AS bucket", "reach", "r AS top", *dims))
    # one row per side and level range: both numbers are bounded
    sizes = materialize(_sizes(y, "n_y").join(_sizes(x, "n_x"), ["side", "bucket"], "left").selectExpr(
        "side", "bucket", f"cast(ceil(n_y / {CELL}) AS int) AS many", f"greatest(1, cast(ceil(coalesce(n_x, 0) / {CELL}) AS int)) AS pieces"), "cells")
    hashed = f"xxhash64({', '.join(dims)})"

    def dealt(rows: DataFrame) -> DataFrame:
        """Candidates in every cell of their pool."""
        return rows.join(F.broadcast(sizes), ["side", "bucket"]).selectExpr(
            *rows.columns, f"cast(pmod({hashed}, many) AS int) AS i", "explode(sequence(0, pieces - 1)) AS j")

    pool = x.join(F.broadcast(sizes), ["side", "bucket"]).selectExpr(
        "side AS x_side", "bucket AS x_bucket", f"cast(pmod({hashed}, pieces) AS int) AS x_j", "explode(sequence(0, many - 1)) AS x_i",
        "reach", "top", *[f"{d} AS x{i}" for i, d in enumerate(dims)])
    xs = [f"x{i}" for i in range(k)]
    cell = ["side", "bucket", "i", "j"]
    pools = pool.groupBy("x_side", "x_bucket", "x_i", "x_j")
    key = ["side", "bucket", "r", "used", "full", *dims]

    def sets(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        owner, mask, killed = free_sets(
            c[dims].to_numpy(float), c["used"].to_numpy(np.uint64), c["r"].to_numpy(float), p[xs].to_numpy(float),
            p["reach"].to_numpy(float), p["top"].to_numpy(float))
        return c[key].iloc[owner].assign(mask=mask.astype(np.int64), own=np.arange(len(owner)) < len(c), killed=killed)

    kind = y.select(*key, F.lit(0).cast("long").alias("mask"), F.lit(False).alias("own"), F.lit(False).alias("killed")).schema
    found = dealt(y).groupBy(*cell).cogroup(pools).applyInPandas(sets, kind)
    if (sizes.agg(F.max("pieces")).first()[0] or 1) > 1:
        found = materialize(found, "sets")

        def tested(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            m = p[xs].to_numpy(float)
            tables = [rank_table(m[:, d]) for d in range(k)]
            low, high = rank_table(p["reach"].to_numpy(float)), rank_table(p["top"].to_numpy(float))
            hit = np.zeros(len(c), bool)
            for lo in range(0, len(c), SLICE):
                some = c.iloc[lo:lo + SLICE]
                r = some["r"].to_numpy(float)
                member = at_most(low, r) & everyone(len(m)) & ~at_most(high, r)
                hit[lo:lo + SLICE] = held(some[dims].to_numpy(float), some["mask"].to_numpy(np.uint64), member, tables)
            return c.loc[hit, [*key, "mask"]]

        masks = found.filter("NOT own").select(*key, "mask").distinct()
        dead = dealt(masks).groupBy(*cell).cogroup(pools).applyInPandas(tested, masks.schema).distinct()
        alive = masks.join(dead, [*key, "mask"], "left_anti").selectExpr("*", "FALSE AS own", "FALSE AS killed")
        found = found.filter("own").unionByName(alive)
    masks = found.groupBy(*key).agg(F.expr("bool_or(own AND killed)").alias("held"), F.expr(
        "collect_set(CASE WHEN NOT own THEN mask END)").alias("free"))
    out = masks.filter("full OR NOT held").selectExpr(
        "side", "r", *dims, "explode(CASE WHEN size(free) > 0 THEN free ELSE array(used) END) AS mask")
    return out.selectExpr("side", "r", *[f"CASE WHEN (mask & {1 << i}L) <> 0 THEN v{i} END AS t{i}" for i in range(k)])


def name_sides(found: DataFrame, sides: Sides) -> DataFrame:
    """Rows ``(side, r, t0..)`` to canonical dependency rows."""
    k = _width(sides)
    rhs = f"element_at(array({', '.join(_text(r) for r, _ in sides)}), side + 1)"
    # padded names are never used: their thresholds are always NULL
    padded = [[left[j] if j < len(left) else f"_{j}" for j in range(k)] for _, left in sides]
    names = ", ".join(f"array({', '.join(map(_text, p))})" for p in padded)
    thresholds = ", ".join(f"t{i}" for i in range(k))
    lhs = (f"map_filter(map_from_arrays(element_at(array({names}), side + 1), array({thresholds})), "
           "(k, v) -> v IS NOT NULL)")
    return make_rfds(found.selectExpr(f"{rhs} AS rhs", "r AS rhs_threshold", f"{lhs} AS lhs"))


def rfd_single(pairs: DataFrame, sides: Sides, medians: DataFrame | None = None) -> DataFrame:
    """Only the dependencies with one left attribute."""
    med = _median_map(medians if medians is not None else distance_medians(pairs))
    intervals = materialize(rfd_intervals(near_points(pairs, sides)), "intervals")
    minima = rfd_minima(intervals, med, sides, level_splits(intervals))
    return name_sides(_single(minima, _width(sides)).distinct(), sides)


def discover(
    pairs: DataFrame,
    rhs: str | None = None,
    lhs: list[str] | None = None,
    compat_int_rhs: bool = False,
    medians: DataFrame | None = None,
    algorithm: Callable[[DataFrame], DataFrame] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Dependencies of one right side, or of every column if ``rhs`` is None.

    ``pairs`` are distinct distance vectors.  ``medians(attr, median)`` may be
    given to save a pass.  ``compat_int_rhs`` ignores fractional right distances
    up to the median; such results may contain dependencies that do not hold.
    ``algorithm`` replaces the search: it gets one ``split_sides`` frame and
    returns canonical rows.  ``pairs`` are read several times and therefore
    written once to the shared folder, unless they are ``stored`` already.
    """
    sides = side_combinations(pairs.columns, rhs, lhs)
    pairs = pairs if stored or is_stored(pairs) else materialize(pairs, "pairs")
    if algorithm is not None:
        frames = [algorithm(split_sides(pairs, r, left)) for r, left in sides]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    if _width(sides) > 62:
        raise ValueError("at most 62 left-side attributes")
    if not all(left for _, left in sides):
        raise ValueError("a dependency needs at least one left-side attribute")
    med, points = _medians_and_points(pairs, sides, medians, compat_int_rhs)
    intervals = materialize(rfd_intervals(points), "intervals")
    splits = level_splits(intervals)
    minima = materialize(rfd_minima(intervals, med, sides, splits), "minima")
    found = _single(minima, _width(sides)).unionByName(_multi(intervals, minima, sides, splits)).distinct()
    return name_sides(found, sides)


def discover_all(
    df: DataFrame,
    attrs: list[str] | None = None,
    id_col: str | None = None,
    metrics: Mapping[str, Metric] | None = None,
    decimals: int = 6,
    compat_int_rhs: bool = False,
    lexicon: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Pair the rows once, then discover the dependencies of every attribute."""
    pairs = pair_distances(df, attrs, id_col, metrics, decimals=decimals,
                           lexicon=lexicon, taxonomy=taxonomy)
    return discover(pairs, compat_int_rhs=compat_int_rhs)
