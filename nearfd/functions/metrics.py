"""Attribute distances as Spark column expressions.

Null rule of every metric: two nulls are at distance 0, one null is at
distance infinity from everything else.  NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
MICROS_PER_DAY = 86_400_000_000

Metric = str | Callable[[Column, Column], Column]

_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def round_half(c: Column, decimals: int) -> Column:
    """Round without the per-row BigDecimal that ``round`` needs."""
    scale = float(10**decimals)
    return F.rint(c * scale) / scale


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def taxonomy_gap(a: Column, b: Column) -> Column:
    """``1 - 1/(path+1)`` of two ancestor maps (node -> steps up)."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    path = F.array_min(F.transform(common, lambda k: F.element_at(a, k) + F.element_at(b, k)))
    known = F.when(F.size(common) == 0, F.lit(1.0)).otherwise(1 - 1 / (path + 1))
    return F.when(a.isNotNull() & b.isNotNull(), known)


def _raw(a: Column, b: Column, kind: Metric) -> Column:
    if callable(kind):
        return kind(a, b)
    if kind == "abs":
        return F.abs(a.cast("double") - b.cast("double"))
    if kind == "days":
        return F.floor(F.abs(micros(a) - micros(b)) / F.lit(MICROS_PER_DAY)).cast("double")
    if kind == "edit":
        return F.when(a == b, F.lit(0.0)).otherwise(F.levenshtein(a, b).cast("double"))
    if kind == "taxonomy":
        return taxonomy_gap(a, b)
    raise ValueError(f"unknown metric {kind!r}")


def distance(a: Column, b: Column, kind: Metric = "abs", decimals: int | None = None) -> Column:
    d = _raw(a, b, kind)
    if kind == "abs":  # NaN minus anything is NaN, and so is infinity minus itself
        d = F.nanvl(d, F.when(a == b, F.lit(0.0)).otherwise(F.lit(INF)))
    if decimals is not None:
        d = round_half(d, decimals)
    def empty(c: Column) -> Column:
        return c.isNull() | F.isnan(c.cast("double")) if kind == "abs" else c.isNull()

    return F.coalesce(d, F.when(empty(a) & empty(b), F.lit(0.0)).otherwise(F.lit(INF)))


def within(a: Column, b: Column, t: float, kind: Metric = "abs", decimals: int = 6) -> Column:
    """``distance(a, b) <= t``, written so that the engine can stop early."""
    if t == INF:
        return F.lit(True)
    if t < 0:
        return F.lit(False)
    if kind == "edit":
        if int(t) == 0:
            return a.eqNullSafe(b)
        near = F.levenshtein(a, b, int(t)) >= 0
        return F.coalesce(near, a.isNull() & b.isNull())
    if kind in ("abs", "taxonomy") or callable(kind):
        return distance(a, b, kind, decimals) <= F.lit(float(t))
    return distance(a, b, kind) <= F.lit(float(t))


def choose_metrics(
    df: DataFrame,
    attrs: list[str] | None = None,
    metrics: Mapping[str, Metric] | None = None,
    lexicon: DataFrame | None = None,
) -> dict[str, Metric]:
    """Metric of each attribute, by column type unless ``metrics`` names one.

    With a ``lexicon(term, node)``, a string column is measured on the taxonomy
    only if all of its non-null values are terms of the lexicon.
    """
    chosen: dict[str, Metric] = {}
    given = dict(metrics or {})
    for name in attrs or df.columns:
        if name not in df.columns:
            raise ValueError(f"unknown attribute {name!r}")
        dtype = df.schema[name].dataType
        if name in given:
            chosen[name] = given[name]
        elif isinstance(dtype, _INTEGRAL + _FRACTIONAL):
            chosen[name] = "abs"
        elif isinstance(dtype, _TEMPORAL):
            chosen[name] = "days"
        elif isinstance(dtype, T.StringType):
            chosen[name] = "edit"
            if lexicon is not None:
                values = df.select(F.col(f"`{name}`").alias("term")).dropna()
                missing = values.join(lexicon.select("term"), "term", "left_anti")
                if missing.isEmpty() and not values.isEmpty():
                    chosen[name] = "taxonomy"
        else:
            raise ValueError(f"attribute {name!r} of type {dtype.simpleString()} has no distance")
    return chosen


def is_whole(dtype: T.DataType, kind: Metric) -> bool:
    """True if the metric only gives whole numbers, so rounding is not needed."""
    return kind in ("days", "edit") or (kind == "abs" and isinstance(dtype, _INTEGRAL))
