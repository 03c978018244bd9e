"""Hard negatives of anchors: exact search along lists that all anchors of a cluster share.

1. Anchors are clustered by angle.  For a cluster with centre ``c`` whose members lie within the angle ``w`` of it,
   ``|x| cos(max(0, angle(c, x) - w))`` times a member's length bounds the member's inner product with ``x``.
2. Candidates are sorted by that bound once for a cluster.  Every member walks the same list and stops when the bound
   of the next candidate, times its length, is below the worst result it still can use: what follows cannot matter.
3. The list is cut into blocks of neighbouring candidates and the anchors into tiles of neighbouring clusters, so one
   cell of a block and a tile has a bounded size.  The same bound, of whole clusters, leaves out cells that no anchor
   of the tile needs.  Results of the cells are merged by rank.

Positives are one walk (limit: the tile's own anchors give a first lower bound), negatives a second one (limits: the
range that each positive's score allows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .codebooks import int_vector, whole_vector

LARGEST = 1 << 25  # components beyond it count as it, so that inner products fit 64 bits
ROW = "id long, label long, v array<int>, cluster int, angle double, norm double"


@dataclass(frozen=True)
class Mining:
    """``low`` percent of a positive's score is the least a negative needs.  Centroids are fitted on at most ``sample``
    anchors.  A block has about ``block_cells`` components, a tile half as many; ``step`` candidates of a list are
    scored at a time."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    clusters: int = 256
    sample: int = 4096
    block_cells: int = 1 << 19
    step: int = 512


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def centroids_of(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Unit centres of ``k`` clusters by angle, neighbours next to each other."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = np.unique(unit, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(k, len(centres))).astype(int)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    chain, left = [0], set(range(1, len(centres)))
    while left:
        chain.append(max(left, key=lambda c: float(centres[c] @ centres[chain[-1]])))
        left.remove(chain[-1])
    return centres[chain]


def bins(counts: list[int], size: int) -> tuple[list[int], list[int]]:
    """(first bin, number of bins) of every cluster: large clusters get several, small neighbours share one."""
    first, pieces, at, room = [], [], 0, size
    for n in counts:
        if n > size or n > room:
            at, room = at + (room < size), size
        first.append(at)
        pieces.append(max(1, math.ceil(n / size)))
        if n > size:
            at += pieces[-1]
        else:
            room -= n
    return first, pieces


def _bin(first: list[int], pieces: list[int]) -> Column:
    at = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    return (at(first) + F.pmod(F.xxhash64("id"), at(pieces))).cast("int")


def _clustered(dims: int, centres: np.ndarray):
    def assign(batches):
        for b in batches:
            v = matrix(pa.chunked_array([b.column("v")]), dims)
            norm = np.linalg.norm(v, axis=1)
            cos = (v @ centres.T) / np.maximum(norm, 1e-12)[:, None]
            of = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("v"), pa.array(of, pa.int32()), pa.array(angle), pa.array(norm)],
                names=["id", "label", "v", "cluster", "angle", "norm"])

    return assign


def best_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of every slot: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _walk(ids, labels, v, norms, a_ids, a_labels, a, a_norms, centre, same: bool, low: np.ndarray, high: np.ndarray, k: int, step: int):
    """(slot, score, candidate place) of members of one cluster; slot = member * n + limit for its n limits.

    ``low`` and ``high`` (members x n) bound the scores a slot takes; ``low`` rises as slots fill.
    """
    cos = lambda x, n: np.clip((x @ centre) / np.maximum(n, 1e-12), -1, 1)
    wide = np.arccos(cos(a, a_norms)).max() + 1e-7
    bound = norms * np.cos(np.maximum(0.0, np.arccos(cos(v, norms)) - wide)) + 1e-7 * norms
    order = np.argsort(-bound, kind="stable")
    n = low.shape[1]
    low = low.astype(np.float64).copy()
    slot, score, place = (np.empty(0, np.int64) for _ in range(3))
    live = np.arange(len(a))
    for lo in range(0, len(order), step):
        live = live[a_norms[live] * bound[order[lo]] + 1e-6 >= low[live].min(1)]
        if not len(live):
            break
        part = order[lo:lo + step]
        s = products(a[live], v[part])
        fits = (a_labels[live][:, None] == labels[part][None, :]) == same
        fits &= a_ids[live][:, None] != ids[part][None, :]
        found = [(slot, score, place)]
        for j in range(n):
            r, c = np.nonzero(fits & (s >= low[live, j][:, None]) & (s <= high[live, j][:, None]))
            found.append((live[r] * n + j, s[r, c], part[c]))
        slot, score, place = (np.concatenate(x) for x in zip(*found))
        keep = best_of(slot, score, ids[place], k)
        slot, score, place = slot[keep], score[keep], place[keep]
        size = np.bincount(slot, minlength=low.size)
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True)) if len(slot) else np.empty(0, np.int64)
        full = last[size[slot[last]] == k]
        low.ravel()[slot[full]] = score[full]
    return slot, score, place


def _cell(dims: int, centres: np.ndarray, same: bool, k: int, step: int):
    def run(rows: pa.Table, targets: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64) for _ in range(4)]
        if rows.num_rows and targets.num_rows:
            num = lambda t, c: t.column(c).to_numpy()
            v, a = matrix(rows.column("v"), dims), matrix(targets.column("a_v"), dims)
            low = np.stack(targets.column("a_low").to_pylist()).astype(np.float64)
            high = np.stack(targets.column("a_high").to_pylist()).astype(np.float64)
            of, parts = num(targets, "a_cluster"), []
            for c in np.unique(of):
                m = np.flatnonzero(of == c)
                slot, score, place = _walk(num(rows, "id"), num(rows, "label"), v, num(rows, "norm"), num(targets, "a_id")[m], num(targets, "a_label")[m],
                                           a[m], num(targets, "a_norm")[m], centres[c], same, low[m], high[m], k, step)
                n = low.shape[1]
                parts.append((num(targets, "a_id")[m][slot // n], slot % n, score, num(rows, "id")[place]))
            out = [np.concatenate(x).astype(np.int64) for x in zip(*parts)]
        return pa.table(dict(zip(("anchor", "slot", "score", "id"), (pa.array(x, pa.int64()) for x in out))))

    return run


def _needs(dims: int, centres: np.ndarray, norm: np.ndarray, width: np.ndarray, pilot: int):
    """Per tile: lower limits of its anchors (from each other, if ``pilot`` > 0) and the clusters that can reach them."""
    def run(t: pa.Table) -> pa.Table:
        a, ids, labels = matrix(t.column("v"), dims), t.column("id").to_numpy(), t.column("label").to_numpy()
        if pilot:
            low = np.full((len(a), 1), -np.inf)
            for lo in range(0, len(a), 512):
                s = products(a[lo:lo + 512], a).astype(np.float64)
                s[(labels[lo:lo + 512, None] != labels[None, :]) | (ids[lo:lo + 512, None] == ids[None, :])] = -np.inf
                if len(a) >= pilot:
                    low[lo:lo + 512, 0] = np.partition(s, len(a) - pilot, axis=1)[:, len(a) - pilot]
        else:
            low = np.stack(t.column("low").to_pylist()).astype(np.float64)
        between = np.arccos(np.clip(centres @ centres.T, -1, 1))
        away = between[t.column("cluster").to_numpy()] - t.column("angle").to_numpy()[:, None] - width[None, :] - 1e-7
        reach = t.column("norm").to_numpy()[:, None] * (norm[None, :] * (np.cos(np.clip(away, 0, np.pi)) + 1e-7)) + 1e-6
        need = np.flatnonzero(((reach >= low.min(1)[:, None]) & (norm >= 0)[None, :]).any(0))
        first = [need.tolist(), *[None] * (len(a) - 1)]
        return pa.table({"tile": t.column("tile"), "id": t.column("id"), "low": pa.array(list(low), pa.list_(pa.float64())),
                         "need": pa.array(first, pa.list_(pa.int32()))})

    return run


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, cfg: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchor`` is a condition on
    the column ``id``.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are the first ``cfg.positives`` other rows
    of its label; of rows with another label, those with ``low * positive <= 100 * score <= 100 * positive`` are a
    positive's negatives, the first ``cfg.negatives`` of them.  Higher scores come first, ties by smaller id.

    Rows with a null id, a null label, a null vector or null or non-finite components take no part, nor do vectors
    that have not the most frequent length (the longer of equally frequent ones).  Of rows that share an id, the one
    with the smallest label and vector counts, so repeated rows count once.  Components beyond 2**25 after scaling
    count as 2**25.  Other columns play no part.  Without anchors, positives or negatives there are no rows.
    """
    spark = df.sparkSession
    kept = (df.filter(whole_vector(F.col(vec_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(int_vector(F.col(vec_col), scale), lambda x: F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")).alias("v")))
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims = lengths[0].n if lengths else 0
    kept = materialize(kept.filter(F.size("v") == dims).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "vectors")
    n_anchors = kept.filter(anchor).count()
    sample = kept.filter(anchor).orderBy(F.xxhash64("id"), "id").limit(cfg.sample).select("v").collect()
    if not sample or not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    centres = centroids_of(np.array([r.v for r in sample], np.float64), min(cfg.clusters, max(1, math.isqrt(n_anchors))))
    rows = materialize(kept.mapInArrow(_clustered(dims, centres), ROW), "clustered")

    stats = {r.cluster: r for r in rows.groupBy("cluster").agg(
        F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max("norm").alias("norm"), F.max("angle").alias("width")).collect()}
    of = lambda name, none: [getattr(stats[c], name) if c in stats else none for c in range(len(centres))]
    size = max(1, cfg.block_cells // dims)
    blocks, tiles = bins(of("n", 0), size), bins(of("anchors", 0), max(1, size // 2))
    norm, width = np.array(of("norm", -1.0)), np.array(of("width", 0.0))
    rows = rows.withColumn("block", _bin(*blocks))
    anchors = rows.filter(anchor).withColumn("tile", _bin(*tiles)).drop("block")
    of_cluster = spark.createDataFrame([(c, f, f + p - 1) for c, (f, p) in enumerate(zip(*blocks))], "cluster int, a int, b int")

    def walk(targets: DataFrame, pilot: int, same: bool, k: int) -> DataFrame:
        needs = materialize(targets.groupBy("tile").applyInArrow(
            _needs(dims, centres, norm, width, pilot), "tile int, id long, low array<double>, need array<int>"), "needs")
        wanted = needs.select("tile", F.explode("need").alias("cluster"))
        if pilot:
            targets = targets.join(needs.select("id", "low"), "id").withColumn("high", F.array(F.lit(float("inf"))))
        spread = wanted.groupBy("cluster").agg(F.collect_list("tile").alias("tiles"))
        left = rows.join(spread, "cluster").select("block", F.explode("tiles").alias("tile"), "id", "label", "v", "norm")
        places = wanted.join(F.broadcast(of_cluster), "cluster").select("tile", F.explode(F.sequence("a", "b")).alias("block")).distinct()
        right = places.join(targets, "tile").select(
            "block", "tile", *[F.col(c).alias(f"a_{c}") for c in ("id", "label", "v", "cluster", "norm", "low", "high")])
        cells = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile"))
        return cells.applyInArrow(_cell(dims, centres, same, k, cfg.step), "anchor long, slot long, score long, id long")

    def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    positives = ranked(walk(anchors, cfg.positives, True, cfg.positives), cfg.positives, "anchor")
    positives = materialize(positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("ps")), "positives")
    # limits are padded to one length; a padded slot takes nothing
    padded = lambda x, none: F.transform(F.sequence(F.lit(0), F.lit(cfg.positives - 1)), lambda i: F.coalesce(
        x(F.get("ps.positive_score", i)).cast("double"), F.lit(none)))
    limits = anchors.join(positives, anchors.id == positives.anchor).select(
        anchors["*"], padded(lambda s: F.ceil(s * cfg.low / 100), float("inf")).alias("low"), padded(lambda s: s, float("-inf")).alias("high"))
    negatives = ranked(walk(limits, 0, False, cfg.negatives), cfg.negatives, "anchor", "slot")
    named = positives.select("anchor", F.posexplode("ps").alias("slot", "p"))
    return negatives.join(named, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "p.positive_id", "rank", F.col("id").alias("negative_id"), "p.positive_score",
        F.col("score").alias("negative_score"))
