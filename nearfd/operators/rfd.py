"""Dependency tables.

Canonical form: ``rfd_id STRING, rhs STRING, rhs_threshold DOUBLE,
lhs MAP<STRING,DOUBLE>``; an attribute that is not in the map is unused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

RFD_SCHEMA = T.StructType([
    T.StructField("rfd_id", T.StringType()),
    T.StructField("rhs", T.StringType()),
    T.StructField("rhs_threshold", T.DoubleType()),
    T.StructField("lhs", T.MapType(T.StringType(), T.DoubleType())),
])


def rfd_key(rhs: Column, threshold: Column, lhs: Column) -> Column:
    """A stable id made from the content of a dependency."""
    parts = F.transform(
        F.array_sort(F.map_entries(lhs)),
        lambda e: F.concat_ws("=", e.getField("key"), e.getField("value").cast("string")))
    text = F.concat_ws("|", rhs, threshold.cast("string"), F.concat_ws(",", parts))
    return F.substring(F.sha2(text, 256), 1, 16)


def make_rfds(df: DataFrame) -> DataFrame:
    """Canonical rows from ``rhs``, ``rhs_threshold`` and ``lhs``."""
    key = rfd_key(F.col("rhs"), F.col("rhs_threshold"), F.col("lhs"))
    return df.select(key.alias("rfd_id"), "rhs", "rhs_threshold", "lhs")


def rfds_from_wide(wide: DataFrame, rhs_col: str = "RHS", digits: int | None = None) -> DataFrame:
    """Wide rows (column ``RHS`` names the right side, one threshold per column)."""
    names = [c for c in wide.columns if c != rhs_col]
    def thr(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return value if digits is None else F.bround(value, digits)
    every = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[thr(c) for c in names]))
    rhs = F.col(f"`{rhs_col}`")
    return make_rfds(wide.select(
        rhs.alias("rhs"), F.element_at(every, rhs).alias("rhs_threshold"),
        F.map_filter(every, lambda k, v: v.isNotNull() & (k != rhs)).alias("lhs")))


def rfds_to_wide(rfds: DataFrame, attrs: list[str], digits: int | None = None) -> DataFrame:
    """One threshold column per attribute and the column ``RHS``."""
    def thr(c: str) -> Column:
        value = rfd_threshold(c)
        return (value if digits is None else F.bround(value, digits)).alias(c)
    return rfds.select(F.col("rhs").alias("RHS"), *[thr(c) for c in attrs])


def union_wide(frames: list[DataFrame]) -> DataFrame:
    """Concatenate wide tables with different columns; missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def name_rhs(frame: DataFrame, dataset_columns: list[str], rhs_col: str = "RHS") -> DataFrame:
    """Per-RHS frame (``RHS`` = threshold) to a wide one that names its right side.

    The right side is the data column that the frame does not have.
    """
    missing = [c for c in dataset_columns if c not in frame.columns]
    if len(missing) != 1:
        raise ValueError(f"expected one missing column, found {missing}")
    return frame.withColumnRenamed(rhs_col, missing[0]).withColumn(rhs_col, F.lit(missing[0]))


def rfd_threshold(attr: str | Column) -> Column:
    """Threshold of an attribute: left side first, then right side, else NULL."""
    name = F.lit(attr) if isinstance(attr, str) else attr
    return F.coalesce(
        F.try_element_at(F.col("lhs"), name),
        F.when(F.col("rhs") == name, F.col("rhs_threshold")))


def filter_rfds(rfds: DataFrame, attrs: list[str], lhs: str | None = "all",
                rhs_excluded: bool = True) -> DataFrame:
    """Dependencies that fit a query over ``attrs``.

    ``lhs='all'``: every attribute has a threshold; ``'any'``: one of them is on
    the left side.  ``rhs_excluded``: none of them is the right side.
    """
    keep = F.lit(True)
    if lhs == "all":
        for a in attrs:
            keep = keep & rfd_threshold(a).isNotNull()
    elif lhs == "any":
        keep = keep & F.arrays_overlap(F.map_keys("lhs"), F.array(*map(F.lit, attrs)))
    elif lhs is not None:
        raise ValueError("lhs is 'all', 'any' or None")
    if rhs_excluded:
        keep = keep & ~F.col("rhs").isin(list(attrs))
    return rfds.filter(keep)


def rank_order(attrs: list[str], nulls: str = "first", by_unused: bool = True) -> list[Column]:
    order: list[Column] = [F.size("lhs").asc()] if by_unused else []
    for a in attrs:
        thr = rfd_threshold(a)
        order.append(thr.asc_nulls_first() if nulls == "first" else thr.asc_nulls_last())
    return order + [F.col("rfd_id")]


def rank_rfds(rfds: DataFrame, attrs: list[str], nulls: str = "first", n: int | None = None,
              by_unused: bool = True) -> DataFrame:
    """Order dependencies: most unused attributes first, then small thresholds.

    ``by_unused=False`` orders by the thresholds of ``attrs`` alone.  Ties are
    broken by ``rfd_id``.  ``n`` keeps the first n (at least one).
    """
    ranked = rfds.orderBy(*rank_order(attrs, nulls, by_unused))
    return ranked if n is None else ranked.limit(max(1, n))


# ------------------------------------------------------------------- text

def title(c: Column) -> Column:
    """``ship_mode`` -> ``Ship Mode``."""
    return F.initcap(F.translate(c, "_", " "))


def format_rfd(rfds: DataFrame, style: str = "human", attrs: list[str] | None = None,
               digits: int | None = None, name: str = "text") -> DataFrame:
    """Add the dependency as text.

    ``human``: ``a(<= 1.0), b(<= 2.0), -> y(<= 0.0)`` with two decimals;
    ``arrow``: ``(a <= 1.0) (b <= 2.0) ---> (y <= 0.0)``;
    ``unicode``: ``(A ≤ 1.0, B ≤ 2.0) → (Y ≤ 0.0)``, empty if a side is empty.
    Left side attributes come in the order of ``attrs``, else by name.
    """
    if attrs:
        entries = F.filter(
            F.transform(F.array(*map(F.lit, attrs)),
                        lambda k: F.struct(k.alias("key"), F.try_element_at(F.col("lhs"), k).alias("value"))),
            lambda e: e.getField("value").isNotNull())
    else:
        entries = F.array_sort(F.map_entries("lhs"))
    if digits is None and style == "human":
        digits = 2

    def num(v: Column) -> Column:
        return (v if digits is None else F.bround(v, digits)).cast("string")

    def each(one: Callable[[Column, Column], Column]) -> Column:
        return F.transform(entries, lambda e: one(e.getField("key"), e.getField("value")))

    rhs, thr = F.col("rhs"), F.col("rhs_threshold")
    if style == "human":
        # fixed values: the signs of this and the next two forms
        left = each(lambda k, v: F.concat(k, F.lit("(<= "), num(v), F.lit("), ")))
        text = F.concat(F.array_join(left, ""), F.lit("-> "), rhs, F.lit("(<= "), num(thr), F.lit(")"))
    elif style == "arrow":
        left = each(lambda k, v: F.concat(F.lit("("), k, F.lit(" <= "), num(v), F.lit(") ")))
        text = F.concat(F.array_join(left, ""), F.lit("---> ("), rhs, F.lit(" <= "), num(thr), F.lit(")"))
        text = F.coalesce(text, F.lit("None"))
    elif style == "unicode":
        left = each(lambda k, v: F.concat(title(k), F.lit(" ≤ "), num(v)))
        text = F.concat(F.lit("("), F.array_join(left, ", "), F.lit(") → ("),
                        title(rhs), F.lit(" ≤ "), num(thr), F.lit(")"))
        text = F.when((F.size("lhs") > 0) & rhs.isNotNull(), text).otherwise(F.lit(""))
    else:
        raise ValueError(f"unknown style {style!r}")
    return rfds.withColumn(name, text)


@dataclass(frozen=True)
class Rfd:
    """One dependency on the driver, as queries are extended and relaxed with it."""

    lhs: dict[str, float]
    rhs: str
    rhs_threshold: float
    rfd_id: str | None = field(default=None, compare=False)

    @classmethod
    def from_row(cls, row: Row) -> Rfd:
        return cls(dict(row["lhs"]), row["rhs"], row["rhs_threshold"], row["rfd_id"])

    @classmethod
    def from_dict(cls, sides: dict) -> Rfd:
        (rhs, threshold), = sides["RHS"].items()
        return cls(dict(sides["LHS"]), rhs, threshold)

    def to_dict(self) -> dict:
        return {"LHS": dict(self.lhs), "RHS": {self.rhs: self.rhs_threshold}}

    def thresholds(self) -> dict[str, float]:
        return {self.rhs: self.rhs_threshold, **self.lhs}

    def __contains__(self, attr: str) -> bool:
        return attr in self.lhs or attr == self.rhs

    def __getitem__(self, attr: str) -> float:
        return self.thresholds()[attr]


def first_rfds(rfds: DataFrame, n: int) -> list[Rfd]:
    """The first ``n`` rows (a user-chosen, small number) as driver objects."""
    return [Rfd.from_row(r) for r in rfds.head(max(1, n))]
