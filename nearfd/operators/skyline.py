"""Skyline (dominance) operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import DOMINANCE_ROWS, dominance_cells, local_minima
from ..session import materialize


def dominates(x: list[Column], y: list[Column]) -> Column:
    """``x`` is at or above ``y`` on every used attribute (NULL = unused)."""
    cond = F.lit(True)
    for a, b in zip(x, y, strict=True):
        cond = cond & F.coalesce(a >= b, F.lit(True))
    return cond


def skyline(df: DataFrame, min_cols: list[str], max_cols: list[str] | tuple = ()) -> DataFrame:
    """Rows no other row beats on ``min_cols`` (small is good) and ``max_cols``.

    First every task keeps its own skyline, then the survivors meet in cells of
    bounded size; regions of the Z curve that cannot reach each other never meet.
    Rows with equal values are all kept.  NULL counts as worst.
    """
    names = [*min_cols, *max_cols]
    dims = [f"_d{i}" for i in range(len(names))]
    worst = F.lit(float("inf"))
    vectors = [F.coalesce(F.col(f"`{c}`").cast("double"), worst).alias(d)
               for c, d in zip(min_cols, dims)]
    vectors += [F.coalesce(-F.col(f"`{c}`").cast("double"), worst).alias(d)
                for c, d in zip(max_cols, dims[len(min_cols):])]
    near = materialize(local_minima(df.select(*vectors), dims).distinct(), "skyline")
    best = dominance_cells(near, dims, None, DOMINANCE_ROWS)
    marked = df.select("*", *vectors)
    return marked.join(best, dims, "left_semi").drop(*dims)
