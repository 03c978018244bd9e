"""Shards as runs of a Hilbert curve over several metadata columns.

Each column is quantised to ``bits`` bits (numbers by their quantiles over all rows, other types by a hash), the
cells are numbered along a Hilbert curve, rows are sorted by that number over the whole cluster, and runs of equal
length become shards.  Rows that are close in every column end up in few shards, so minimum and maximum of each
column prune files whichever column a query filters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n x dimensions, ``bits`` bits each) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the sub-cubes, from coarse to fine
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, 0)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_column(cells: list[Column], bits: int) -> Column:
    """Curve index of integer cell columns."""
    @F.pandas_udf(T.LongType())
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([p.to_numpy() for p in parts]), bits))

    return index(*cells)


def _rank(value: Column, cuts: list[float]) -> Column:
    """How many of the split points lie below a value."""
    return F.size(F.filter(F.lit(cuts), lambda c: c < value))


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Cell of each column; nulls share the lowest cell.

    The split points are at most ``2**bits - 1`` numbers per column, from all rows.
    """
    numeric = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(F.col(d).cast("double"), steps, 10000).alias(f"q{i}") for i, d in enumerate(numeric)],
                   F.lit(1).alias("one")).first()
    cells = []
    for d in dims:
        if d in numeric:
            cuts = sorted(set(found[f"q{numeric.index(d)}"] or []))
            cell = _rank(F.col(d).cast("double"), cuts) if cuts else F.lit(0)
        else:
            cell = F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(1 << bits)).cast("int")
        cells.append(F.when(F.col(d).isNull(), 0).otherwise(cell).cast("int"))
    return cells


def ordered(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``df`` with dense positions 0, 1, ... in the order of ``keys``.

    Rows are dealt by ranges of the keys and sorted inside each range; the sorted rows are stored with their range
    and place, and only the range sizes are summed in one task.  Many equal keys are no hot group if the last
    key tells them apart.
    """
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(dealt.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}), "sorted")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_range").count().select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (stored.join(starts, F.col("_range") == F.col("_r"))
            .withColumn(position, F.col("_start") + F.col("_place")).drop("_range", "_place", "_r", "_start"))


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, id_col: str, tie_cols: list[str] = (),
                   bits: int = 5) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in the shard from 0).

    The law is ``rows``: shard sizes differ by at most one row.  Ties on the curve are ordered by ``tie_cols`` (for
    instance a checksum of the text, so that equal texts of a cell are neighbours; equal texts with other metadata lie in
    other cells, which the law ``rows`` allows), then by ``id_col``, then by a hash
    of the whole row; rows equal in all of these are interchangeable.  Null metadata share the lowest cell.  Fewer rows than shards leave
    shards empty; an empty table stays empty.  Columns named ``shard`` or ``slot`` are replaced.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    named = lambda names, as_: [F.col(f"`{c}`").alias(f"{as_}{i}") for i, c in enumerate(names)]
    # own names first: a lambda looks names up among the new columns of its own select, too
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *named(dims, "d"), *named(tie_cols, "t"), *named([id_col], "id"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("hash"))
    own = [f"d{i}" for i in range(len(dims))]
    keys = [hilbert_column(quantised(base, own, bits), bits), *[F.col(f"t{i}") for i in range(len(tie_cols))], F.col("id0"), F.col("hash")]
    keyed = base.select("row", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    placed = ordered(keyed, [f"k{i}" for i in range(len(keys))], "rank")
    n = max(df.count(), 1)
    # shard s holds the ranks from ceil(s n / shards) up to ceil((s + 1) n / shards)
    shard = F.expr(f"(rank * {shards}) div {n}")
    first = F.expr(f"((rank * {shards}) div {n} * {n} + {shards - 1}) div {shards}")
    return placed.select("row.*", shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))
