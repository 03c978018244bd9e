"""Checking dependencies against a table.

Rows with equal values on the attributes of a dependency behave alike, so they
are folded into one *node* (its smallest row id and its number of rows) before
anything is paired.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, choose_metrics, distance, within
from .rfd import Rfd
from .simjoin import Side, similarity_join


def rfd_nodes(df: DataFrame, rfd: Rfd, id_col: str) -> DataFrame:
    """``(node, weight, <attributes>)``: the distinct tuples of a dependency."""
    attrs = [*rfd.lhs, rfd.rhs]
    return df.groupBy(*[F.col(f"`{c}`") for c in attrs]).agg(
        F.min(F.col(f"`{id_col}`")).alias("node"), F.count("*").alias("weight"))


def node_members(df: DataFrame, nodes: DataFrame, rfd: Rfd, id_col: str) -> DataFrame:
    """``(<id>, node)`` for every row."""
    attrs = [*rfd.lhs, rfd.rhs]
    n = nodes.select("node", *[F.col(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(attrs)])
    cond = reduce(lambda a, b: a & b, [
        F.col(f"`{c}`").eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(attrs)])
    return df.join(n, cond).select(F.col(f"`{id_col}`"), "node")


def rfd_edges(df: DataFrame, rfd: Rfd, id_col: str,
              metrics: Mapping[str, Metric] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` pairs of nodes within all thresholds, ``src < dst``."""
    kinds = choose_metrics(df, [*rfd.lhs, rfd.rhs], metrics)
    nodes = nodes if nodes is not None else rfd_nodes(df, rfd, id_col)
    on = {c: (kinds[c], t) for c, t in rfd.thresholds().items()}
    met = similarity_join(nodes, nodes, on, "inner", extra=lambda l, r: l("node") < r("node"))
    return met.select(F.col("node_l").alias("src"), F.col("node_r").alias("dst"))


def rfd_violations(df: DataFrame, rfd: Rfd, id_col: str,
                   metrics: Mapping[str, Metric] | None = None) -> DataFrame:
    """Pairs of nodes that are close on the left side but not on the right one.

    ``n_pairs`` is the number of row pairs behind a pair of nodes and
    ``distance`` their right-side distance.
    """
    kinds = choose_metrics(df, [*rfd.lhs, rfd.rhs], metrics)
    nodes = rfd_nodes(df, rfd, id_col)
    on = {c: (kinds[c], t) for c, t in rfd.lhs.items()}
    far = _far(rfd, kinds[rfd.rhs])
    met = similarity_join(nodes, nodes, on, "inner",
                          extra=lambda l, r: (l("node") < r("node")) & far(l, r))
    gap = distance(F.col(f"`{rfd.rhs}_l`"), F.col(f"`{rfd.rhs}_r`"), kinds[rfd.rhs], 6)
    return met.select(F.col("node_l").alias("node_a"), F.col("node_r").alias("node_b"),
                      (F.col("weight_l") * F.col("weight_r")).alias("n_pairs"), gap.alias("distance"))


def _far(rfd: Rfd, kind: Metric):
    def far(l: Side, r: Side) -> Column:
        return ~within(l(rfd.rhs), r(rfd.rhs), rfd.rhs_threshold, kind)
    return far


def rfd_holds(df: DataFrame, rfds: list[Rfd], id_col: str,
              metrics: Mapping[str, Metric] | None = None) -> DataFrame:
    """``(rfd_id, holds, violating)``; ``violating`` counts nodes in a violation.

    A semi-join: each node stops at its first violating partner.
    """
    frames = []
    for rfd in rfds:
        kinds = choose_metrics(df, [*rfd.lhs, rfd.rhs], metrics)
        nodes = rfd_nodes(df, rfd, id_col)
        on = {c: (kinds[c], t) for c, t in rfd.lhs.items()}
        bad = similarity_join(nodes, nodes, on, "left_semi", extra=_far(rfd, kinds[rfd.rhs]))
        frames.append(bad.agg(F.count("*").alias("violating")).select(
            F.lit(rfd.rfd_id).alias("rfd_id"), (F.col("violating") == 0).alias("holds"), "violating"))
    return reduce(DataFrame.unionByName, frames)
