"""Extent of a dependency: the largest set of rows that pairwise satisfy it.

That is a maximum-weight clique over the distinct tuples.  Nodes are ordered by
degree, so each node has at most sqrt(2 * edges) later neighbours; every clique
lies in the later neighbourhood of its first node.  These subproblems are
independent rows: large ones are split by one more node on Spark until each is
small enough to be solved inside a task.  The result is exact.

If every attribute is a number, a date or compared for equality, such a set is
what a box of the thresholds' size holds, and no pair is needed: anchors along
the most selective attribute are dealt in pieces, each with the rows that its
windows reach (its halo), and inside a window the next attribute is swept.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import INF, MICROS_PER_DAY, Metric, choose_metrics, micros
from ..session import materialize
from ..sources.tables import with_row_id
from .check import node_members, rfd_edges, rfd_nodes
from .rfd import Rfd

TASK_NODES = 192
PEEL_ROUNDS = 8
PIECE = 512  # anchors of a piece
MAX_PIECES = 4096


def _heaviest(members: list[tuple[int, int, set[int]]], floor: int) -> tuple[int, list[int]] | None:
    """Heaviest clique above ``floor``; of equal ones the first in id order.

    Branch and bound: the smallest id is tried inside before outside, and a
    branch is cut when the colour classes cannot lift it above the best.
    """
    members = sorted(members)
    ids = [m[0] for m in members]
    weight = [m[1] for m in members]
    place = {n: i for i, n in enumerate(ids)}
    adj = [0] * len(ids)
    for i, (_, _, nbrs) in enumerate(members):
        for n in nbrs:
            j = place[n]
            adj[i] |= 1 << j
            adj[j] |= 1 << i
    best, found = floor, None

    def bound(p: int) -> int:
        total = 0
        while p:
            rest, top = p, 0
            while rest:
                low = rest & -rest
                i = low.bit_length() - 1
                top = max(top, weight[i])
                p ^= low
                rest = (rest ^ low) & ~adj[i]
            total += top
        return total

    stack: list[tuple[int, int, tuple[int, ...]]] = [((1 << len(ids)) - 1, 0, ())]
    while stack:
        p, w, chosen = stack.pop()
        if w > best:
            best, found = w, chosen
        if not p or w + bound(p) <= best:
            continue
        low = p & -p
        i = low.bit_length() - 1
        stack.append((p ^ low, w, chosen))
        stack.append((p & adj[i], w + weight[i], (*chosen, i)))
    return None if found is None else (best, [ids[i] for i in found])


def _solve(batches):
    best: tuple[int, list[int]] | None = None
    for pdf in batches:
        for prefix, w, members in zip(pdf["prefix"], pdf["w"], pdf["members"], strict=True):
            prefix = [int(x) for x in prefix]
            got = (int(w), sorted(prefix))
            floor = -1 if best is None else best[0] - int(w) - 1
            ms = [] if members is None else [
                (int(m["node"]), int(m["weight"]), {int(x) for x in m["nbrs"]}) for m in members]
            part = _heaviest(ms, max(floor, 0)) if ms else None
            if part is not None:
                got = (int(w) + part[0], sorted(prefix + part[1]))
            if best is None or got[0] > best[0] or (got[0] == best[0] and got[1] < best[1]):
                best = got
    if best is not None:
        yield pd.DataFrame({"weight": [best[0]], "clique": [best[1]]})


def max_clique(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(weight, clique)``: the heaviest clique, smallest ids on ties.

    ``nodes(node, weight)``, ``edges(src, dst)`` with each edge once.
    """
    nodes = materialize(nodes.select(F.col("node").cast("bigint"), F.col("weight").cast("bigint")), "nodes")
    edges = materialize(edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")), "edges")

    def weight_of(side: str) -> DataFrame:
        return nodes.select(F.col("node").alias(side), F.col("weight").alias(f"w_{side}"))

    heavy = edges.join(weight_of("src"), "src").join(weight_of("dst"), "dst")
    low = max(nodes.agg(F.max("weight")).first()[0] or 0,
              heavy.agg(F.max(F.col("w_src") + F.col("w_dst"))).first()[0] or 0)

    # nodes that cannot reach the known weight with all their neighbours
    for _ in range(PEEL_ROUNDS):
        ends = (heavy.select(F.col("src").alias("node"), F.col("w_dst").alias("w"))
                .unionByName(heavy.select(F.col("dst").alias("node"), F.col("w_src").alias("w"))))
        around = ends.groupBy("node").agg(F.sum("w").alias("around"))
        kept = (nodes.join(around, "node", "left")
                .filter(F.col("weight") + F.coalesce("around", F.lit(0)) >= low).select("node", "weight"))
        kept = materialize(kept, "nodes")
        done = kept.count() == nodes.count()
        nodes = kept
        if done:
            break
        edges = materialize(edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
                            .join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), "edges")
        heavy = edges.join(weight_of("src"), "src").join(weight_of("dst"), "dst")

    degree = (edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node")
              .agg(F.count("*").alias("deg")))
    def deg(side: str) -> DataFrame:
        return degree.select(F.col("node").alias(side), F.col("deg").alias(f"d_{side}"))
    directed = edges.join(deg("src"), "src").join(deg("dst"), "dst")
    forward = (F.struct("d_src", "src") < F.struct("d_dst", "dst"))
    later = directed.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("node"),
                            F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("nbr"))
    later = later.join(nodes.select(F.col("node").alias("nbr"), F.col("weight").alias("w")), "nbr")
    out = materialize(
        nodes.join(later.groupBy("node").agg(F.collect_list("nbr").alias("out"), F.sum("w").alias("w_out")),
                   "node", "left")
        .select("node", "weight", F.coalesce("out", F.array().cast("array<bigint>")).alias("out"),
                F.coalesce("w_out", F.lit(0)).alias("w_out")), "later")

    problems = (out.filter(F.col("weight") + F.col("w_out") >= low)
                .select(F.array("node").alias("prefix"), F.col("weight").alias("w"), F.col("out").alias("cands")))
    step = out.select(F.col("node").alias("c"), F.col("weight").alias("w_c"), F.col("out").alias("out_c"))
    ready = problems.filter(F.size("cands") <= TASK_NODES)
    large = problems.filter(F.size("cands") > TASK_NODES)
    parts = [ready]
    while not large.isEmpty():
        split = (large.select("prefix", "w", "cands", F.explode("cands").alias("c")).join(step, "c")
                 .select(F.concat("prefix", F.array("c")).alias("prefix"), (F.col("w") + F.col("w_c")).alias("w"),
                         F.array_intersect("cands", "out_c").alias("cands")))
        split = materialize(split, "split")
        parts.append(split.filter(F.size("cands") <= TASK_NODES))
        large = split.filter(F.size("cands") > TASK_NODES)
    work = parts[0]
    for p in parts[1:]:
        work = work.unionByName(p)

    inner = (work.select("prefix", "w", "cands", F.explode_outer("cands").alias("c")).join(step, "c", "left")
             .select("prefix", "w", F.when(F.col("c").isNotNull(), F.struct(
                 F.col("c").alias("node"), F.col("w_c").alias("weight"),
                 F.array_intersect("out_c", "cands").alias("nbrs"))).alias("member")))
    # at most TASK_NODES members per row
    rows = inner.groupBy("prefix", "w").agg(F.collect_list("member").alias("members"))
    solved = rows.mapInPandas(_solve, schema="weight bigint, clique array<bigint>")
    return solved.orderBy(F.desc("weight"), F.asc("clique")).limit(1)


def _axes(kinds: Mapping[str, Metric], thresholds: Mapping[str, float]) -> tuple[list[str], dict[str, str]] | None:
    """(attributes compared for equality, axes of the box with their metric), or None if pairs are needed."""
    equal, axes = [], {}
    for c, t in thresholds.items():
        if t == INF:
            continue
        if t == 0 and kinds[c] == "abs" or kinds[c] == "edit" and t < 1:
            equal.append(c)
        elif kinds[c] in ("abs", "days"):
            axes[c] = kinds[c]
        else:
            return None
    return equal, axes


def _window_ends(v: np.ndarray, starts: np.ndarray, t: float, kind: str) -> np.ndarray:
    """For sorted ``v``: the end of the window of values within ``t`` of each start's value."""
    if kind == "days":
        gap, reach = (lambda d: d // MICROS_PER_DAY), (math.floor(t) + 1) * MICROS_PER_DAY
    else:
        gap, reach = (lambda d: np.rint(d * 1e6) / 1e6), t + 1e-6
    first = v[starts]
    ends = np.searchsorted(v, first + reach, side="right")
    while True:  # the slack holds few values; the metric decides
        far = (ends > starts) & (gap(v[np.maximum(ends - 1, 0)] - first) > t)
        if not far.any():
            return ends
        ends = ends - far


def heaviest_box(values: np.ndarray, weight: np.ndarray, ids: np.ndarray, axes: list[tuple[float, str]], floor: int,
                 anchors: np.ndarray | None = None) -> tuple[int, list] | None:
    """(weight, sorted ids) of the heaviest box with at least ``floor``; of equal ones the smallest id list.

    Windows of the first axis are tried from the heaviest on; one lighter than the best known box ends the search.
    ``anchors`` marks the rows at which a window of the first axis may begin.
    """
    best: tuple[int, list] | None = None

    def better(w: int, chosen: list) -> None:
        nonlocal best
        if best is None or w > best[0] or w == best[0] and chosen < best[1]:
            best = (w, chosen)

    def sweep(rows: np.ndarray, axis: int, begin: np.ndarray | None) -> None:
        if axis == len(axes):
            if (w := int(weight[rows].sum())) >= max(floor, best[0] if best else 0):
                better(w, sorted(ids[rows].tolist()))
            return
        t, kind = axes[axis]
        rows = rows[np.argsort(values[rows, axis], kind="stable")]
        v = values[rows, axis]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, int)
        if begin is not None:
            some = np.add.reduceat(begin[rows].astype(int), starts) > 0 if len(starts) else np.empty(0, bool)
            starts = starts[some]
        ends = _window_ends(v, starts, t, kind)
        upto = np.append(0, np.cumsum(weight[rows]))
        sums = upto[ends] - upto[starts]
        for i in np.argsort(-sums, kind="stable"):
            if sums[i] < max(floor, best[0] if best else 0):
                break
            sweep(rows[starts[i]:ends[i]], axis + 1, None)

    sweep(np.arange(len(ids)), 0, anchors)
    return best


def max_box(nodes: DataFrame, equal: list[str], axes: dict[str, str], thresholds: Mapping[str, float]) -> DataFrame:
    """One row ``(weight, clique)`` like ``max_clique``, of nodes ``(node, weight, <attributes>)`` in boxes.

    Null and NaN lie together and apart from all numbers, and so does each infinity.  A piece's task holds the rows its
    windows reach, as one number per axis.
    """
    names = list(axes)
    numbers = {c: micros(F.col(f"`{c}`")).cast("double") if kind == "days" else F.col(f"`{c}`").cast("double") for c, kind in axes.items()}
    odd = {c: F.when(x.isNull() | F.isnan(x), 2).when(x == INF, 1).when(x == -INF, -1).otherwise(0) for c, x in numbers.items()}
    same = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`") + 0.0) if isinstance(nodes.schema[c].dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{c}`") for c in equal}
    rows = materialize(nodes.select(
        "node", "weight", F.md5(F.to_json(F.array(*[F.to_json(F.struct(x.alias("v"))) for x in same.values()], *[o.cast("string") for o in odd.values()]))).alias("g")
        if equal or names else F.lit("").alias("g"),
        *[F.when(odd[c] == 0, numbers[c]).otherwise(0.0).alias(f"d{i}") for i, c in enumerate(names)]), "box")
    if not names:
        return rows.groupBy("g").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_list("node")).alias("clique")).select(
            "weight", "clique").orderBy(F.desc("weight"), F.asc("clique")).limit(1)
    spans = rows.agg(F.count("*").alias("n"), *[F.expr(f"max(d{i}) - min(d{i})").alias(f"s{i}") for i in range(len(names))]).first()
    size = [(math.floor(thresholds[c]) + 1) * MICROS_PER_DAY if axes[c] == "days" else thresholds[c] for c in names]
    order = sorted(range(len(names)), key=lambda i: -(spans[f"s{i}"] or 0) / max(size[i], 1e-9))
    first, slack = f"d{order[0]}", size[order[0]] + 1e-6
    pieces = max(1, min(MAX_PIECES, math.ceil(spans["n"] / PIECE)))
    marks = rows.agg(F.percentile_approx(first, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(10_000))).first()[0] if pieces > 1 else []
    bounds = np.unique(np.array(marks or [], float))
    steps = [(thresholds[names[i]], axes[names[i]]) for i in order]

    def deal(batches):
        for pdf in batches:
            own = np.searchsorted(bounds, pdf[first].to_numpy(), side="left")
            low = np.searchsorted(bounds, pdf[first].to_numpy() - slack, side="left")
            for back in range(int((own - low).max(initial=-1)) + 1):
                some = own - low >= back
                yield pdf[some].assign(piece=(own - back)[some], anchor=back == 0)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = heaviest_box(pdf[[f"d{i}" for i in order]].to_numpy(float), pdf["weight"].to_numpy(), pdf["node"].to_numpy(), steps, 0,
                           pdf["anchor"].to_numpy())
        return pd.DataFrame({"weight": np.empty(0, np.int64), "clique": np.empty(0, object)}) if got is None else pd.DataFrame({"weight": [got[0]], "clique": [got[1]]})

    schema = T.StructType([*rows.schema.fields, T.StructField("piece", T.LongType()), T.StructField("anchor", T.BooleanType())])
    boxes = rows.mapInPandas(deal, schema).groupBy("g", "piece").applyInPandas(solve, "weight bigint, clique array<bigint>")
    return boxes.orderBy(F.desc("weight"), F.asc("clique")).limit(1)


def rfd_extent(df: DataFrame, rfd: Rfd, id_col: str,
               metrics: Mapping[str, Metric] | None = None) -> DataFrame:
    """Ids of the rows in the largest set that pairwise satisfies ``rfd``; ids may have any type with an order.

    Numbers, dates and attributes compared for equality are swept in boxes; other metrics need a maximum clique.
    """
    nodes = rfd_nodes(df, rfd, id_col)
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        nodes = with_row_id(nodes.orderBy("node"), "_place").withColumn("node", F.col("_place")).drop("_place")
    nodes = materialize(nodes, "tuples")
    box = _axes(choose_metrics(df, [*rfd.lhs, rfd.rhs], metrics), rfd.thresholds())
    best = max_clique(nodes, rfd_edges(df, rfd, id_col, metrics, nodes)) if box is None else max_box(nodes, *box, rfd.thresholds())
    chosen = best.select(F.explode("clique").alias("node"))
    members = node_members(df, nodes, rfd, id_col)
    return members.join(chosen, "node", "left_semi").select(F.col(f"`{id_col}`"))
