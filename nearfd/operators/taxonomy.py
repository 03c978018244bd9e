"""Distances on a user-supplied taxonomy.

``taxonomy(child, parent)`` holds the edges and ``lexicon(term, node)`` says
where a term sits.  In a forest (one parent at most, no cycle) distances come from
pointer doubling: tables of the 2^k-th ancestors, by which pairs of nodes climb to
their nearest common ancestor, so depth d needs about log d rounds and no ancestor
set.  Otherwise ancestor sets grow level by level with joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import taxonomy_gap
from ..session import materialize


STORED = 4  # climbs between two written tables


def ancestors(nodes: DataFrame, taxonomy: DataFrame, max_steps: int | None = None) -> DataFrame:
    """``(node, ancestor, steps)`` with the fewest steps, the node itself at 0.

    All ancestors by default; ``max_steps`` is for callers that need no farther ones.  A level without a new
    ancestor ends the search, also on cycles.
    """
    edges = taxonomy.select("child", "parent").dropna().distinct()
    level = materialize(
        nodes.select("node").dropna().distinct()
        .select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")), "anc")
    seen = level
    depth = 0
    while max_steps is None or depth < max_steps:
        depth += 1
        grown = (level.join(edges, F.col("ancestor") == F.col("child"))
                 .select("node", F.col("parent").alias("ancestor")).distinct()
                 .join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
                 .withColumn("steps", F.lit(depth)))
        level = materialize(grown, "anc")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def forest_jumps(taxonomy: DataFrame) -> tuple[list[DataFrame], DataFrame] | None:
    """``([(child, up)] of the 2^k-th ancestors, (node, depth, root))``, or None if the edges are no forest.

    Each round follows every pointer once more from where it leads; a node without a 2^k-th ancestor leaves the
    table of that round.  A table that still has rows after as many steps as there are nodes has a cycle.
    """
    edges = materialize(taxonomy.select("child", "parent").dropna().filter("child <> parent").distinct(), "edges")
    if not edges.groupBy("child").count().filter("count > 1").isEmpty():
        return None
    jumps = [edges.withColumnRenamed("parent", "up")]
    n = edges.count()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    top = materialize(nodes.join(edges, F.col("node") == F.col("child"), "left").select(
        "node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")), "depths")
    while not jumps[-1].isEmpty():
        if 2 ** (len(jumps) - 1) > n:
            return None
        last = jumps[-1]
        onward = last.select(F.col("child").alias("mid"), F.col("up").alias("far"))
        jumps.append(materialize(last.join(onward, F.col("up") == F.col("mid")).select("child", F.col("far").alias("up")), "jumps"))
        beyond = top.select(F.col("node").alias("at"), F.col("root").alias("far"), F.col("depth").alias("more"))
        top = materialize(top.join(beyond, F.col("root") == F.col("at")).select(
            "node", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "depths")
    return jumps[:-1], top


def _climb(pairs: DataFrame, jump: DataFrame, *sides: str) -> DataFrame:
    """Adds ``up_<side>``, the ancestor in ``jump`` of the node in each side's column."""
    for s in sides:
        up = jump.select(F.col("child").alias(f"of_{s}"), F.col("up").alias(f"up_{s}"))
        pairs = pairs.join(up, F.col(s) == F.col(f"of_{s}"), "left").drop(f"of_{s}")
    return pairs


def forest_paths(pairs: DataFrame, jumps: list[DataFrame], depths: DataFrame) -> DataFrame:
    """``(a, b, path)``: edges between two nodes through their nearest common ancestor; null without one.

    The deeper node climbs to the other's depth by the bits of the difference; then both climb by falling powers of two
    as long as they stay apart.
    """
    def placed(side: str) -> DataFrame:
        return depths.select(F.col("node").alias(side), F.col("depth").alias(f"d_{side}"), F.col("root").alias(f"r_{side}"))

    at = pairs.select("a", "b").distinct().join(placed("a"), "a", "left").join(placed("b"), "b", "left")
    # a node without any edge is its own root
    for s in ("a", "b"):
        at = at.withColumns({f"d_{s}": F.coalesce(f"d_{s}", F.lit(0).cast("long")), f"r_{s}": F.coalesce(f"r_{s}", s)})
    deep = F.col("d_a") >= F.col("d_b")
    at = at.select("a", "b", F.when(deep, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(deep, F.col("b")).otherwise(F.col("a")).alias("v"),
                   F.abs(F.col("d_a") - F.col("d_b")).alias("gap"), (F.col("r_a") == F.col("r_b")).alias("met"), F.lit(0).cast("long").alias("moved"))
    at = materialize(at, "pairs")
    for k in reversed(range(len(jumps))):
        climbs = F.col("met") & F.col("gap").bitwiseAND(F.lit(1 << k)).cast("boolean")
        at = _climb(at, jumps[k], "u").withColumn("u", F.when(climbs, F.col("up_u")).otherwise(F.col("u"))).drop("up_u")
        if k % STORED == 0:
            at = materialize(at, "pairs")
    for k in reversed(range(len(jumps))):
        at = _climb(at, jumps[k], "u", "v")
        apart = F.col("met") & (F.col("up_u") != F.col("up_v"))
        at = at.select("a", "b", "gap", "met", *[F.when(apart, F.col(f"up_{s}")).otherwise(F.col(s)).alias(s) for s in ("u", "v")],
                       (F.col("moved") + F.when(apart, 1 << k).otherwise(0)).alias("moved"))
        if k % STORED == 0:
            at = materialize(at, "pairs")
    return at.select("a", "b", F.when(F.col("met"), F.col("gap") + 2 * (F.col("moved") + (F.col("u") != F.col("v")).cast("long"))).alias("path"))


def ancestor_maps(lexicon: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(term, up)``: map from each ancestor of the term's first node to its steps."""
    first = lexicon.select("term", "node").dropna().groupBy("term").agg(F.min("node").alias("node"))
    up = (ancestors(first, taxonomy).groupBy("node")
          .agg(F.map_from_entries(F.collect_list(F.struct("ancestor", "steps"))).alias("up")))
    return first.join(up, "node").select("term", "up")


def with_ancestors(df: DataFrame, attr: str, maps: DataFrame) -> DataFrame:
    """Replace ``attr`` by its ancestor map; a term without a node stands alone."""
    c = F.col(f"`{attr}`")
    known = maps.select(F.col("term").alias("_term"), F.col("up").alias("_up"))
    alone = F.when(c.isNotNull(), F.create_map(F.concat(F.lit("term:"), c), F.lit(0)))
    joined = df.join(known, c == F.col("_term"), "left")
    return joined.select(*[
        F.coalesce(F.col("_up"), alone).alias(n) if n == attr else F.col(f"`{n}`") for n in df.columns])


def taxonomy_distance(pairs: DataFrame, lexicon: DataFrame, taxonomy: DataFrame,
                      left: str = "left", right: str = "right") -> DataFrame:
    """Add ``distance`` = ``1 - 1/(shortest path + 1)`` to pairs of terms.

    It is NULL when a term is not in the lexicon and 1 when no ancestor is shared.
    """
    forest = forest_jumps(taxonomy)
    if forest is not None:
        first = materialize(lexicon.select("term", "node").dropna().groupBy("term").agg(F.min("node").alias("node")), "terms")
        a = first.select(F.col("term").alias(left), F.col("node").alias("_a"))
        b = first.select(F.col("term").alias(right), F.col("node").alias("_b"))
        rows = pairs.join(a, left, "left").join(b, right, "left")
        known = rows.select(F.col("_a").alias("a"), F.col("_b").alias("b")).dropna()
        paths = forest_paths(known, *forest).select(F.col("a").alias("_x"), F.col("b").alias("_y"), "path")
        out = rows.join(paths, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
        gap = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.coalesce(1 - 1 / (F.col("path") + 1), F.lit(1.0)))
        return out.select(*pairs.columns, gap.alias("distance"))
    maps = ancestor_maps(lexicon, taxonomy)
    a = maps.select(F.col("term").alias(left), F.col("up").alias("_a"))
    b = maps.select(F.col("term").alias(right), F.col("up").alias("_b"))
    return (pairs.join(a, left, "left").join(b, right, "left")
            .withColumn("distance", taxonomy_gap(F.col("_a"), F.col("_b")))
            .select(*pairs.columns, "distance"))


def taxonomy_pairs(left: DataFrame, right: DataFrame, lexicon: DataFrame, taxonomy: DataFrame, t: float) -> DataFrame:
    """``(l, r)``: pairs of the distinct terms of two one-column tables whose
    taxonomy distance is at most ``t`` (below 1).

    A distance bounds the path, so only ancestors that few steps away are joined.
    """
    if not 0 <= t < 1:
        raise ValueError("the threshold has to be in [0, 1)")
    steps = math.floor(t / (1 - t) + 1e-9)
    a, b = left.toDF("l").dropna().distinct(), right.toDF("r").dropna().distinct()
    first = lexicon.select("term", "node").dropna().groupBy("term").agg(F.min("node").alias("node"))
    up = ancestors(first, taxonomy, steps) if steps else first.select(
        "node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")).distinct()
    places = first.join(up, "node").select("term", "ancestor", "steps")
    x = a.join(places, F.col("l") == F.col("term")).select("l", "ancestor", F.col("steps").alias("s_l"))
    y = b.join(places, F.col("r") == F.col("term")).select("r", "ancestor", F.col("steps").alias("s_r"))
    near = x.join(y, "ancestor").filter(F.col("s_l") + F.col("s_r") <= steps).select("l", "r")
    return near.unionByName(a.join(b, F.col("l") == F.col("r"))).distinct()
