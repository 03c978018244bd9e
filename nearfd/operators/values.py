"""Small value reports: distinct values, islands, consecutive checks, sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ISLAND_RANGE = 1 << 20


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(attr, value)``: sorted distinct non-null values of each column as text.

    One row per value, so that no value list has to fit into one row.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("attr"), F.lit(i).alias("pos"), F.col(f"`{c}`").cast("string").alias("value"),
                 F.col(f"`{c}`").try_cast("double").alias("num") if _numeric(df, c)
                 else F.lit(None).cast("double").alias("num"))
        for i, c in enumerate(columns)])).alias("v")).select("v.*")
    return (long.dropna(subset=["value"]).distinct()
            .orderBy("pos", "num", "value").select("attr", "value"))


def _numeric(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] not in ("string", "date", "timestamp", "timestamp_ntz", "boolean")


def value_islands(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Maximal runs ``(first, last, size)`` of consecutive whole numbers.

    Values are grouped into fixed ranges; runs are found inside each range and
    then joined across range borders, which only touches one row per run end.
    """
    keys = [by] if by else []
    v = F.col(f"`{column}`").cast("bigint")
    values = (df.select(*[F.col(f"`{k}`") for k in keys], v.alias("v")).dropna(subset=["v"]).distinct()
              .withColumn("rng", F.floor(F.col("v") / F.lit(ISLAND_RANGE))))
    inside = Window.partitionBy(*keys, "rng").orderBy("v")
    runs = (values.withColumn("g", F.col("v") - F.row_number().over(inside))
            .groupBy(*keys, "rng", "g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    # a run that touches a border may go on in the next range
    edge = (F.pmod(F.col("lo"), F.lit(ISLAND_RANGE)) == 0) | (
        F.pmod(F.col("hi"), F.lit(ISLAND_RANGE)) == ISLAND_RANGE - 1)
    middle = runs.filter(~edge).select(*keys, F.col("lo").alias("first"), F.col("hi").alias("last"))
    order = Window.partitionBy(*keys).orderBy("lo")
    touch = runs.filter(edge)
    fresh = F.when(F.lag("hi").over(order) == F.col("lo") - 1, 0).otherwise(1)
    joined = (touch.withColumn("new", fresh)
              .withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*keys, "g").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
              .select(*keys, "first", "last"))
    return middle.unionByName(joined).withColumn("size", F.col("last") - F.col("first") + 1)


def format_islands(islands: DataFrame, by: str | None = None) -> DataFrame:
    """``[a-b] ∪ [c]`` text of the runs of a (short) value list."""
    one = F.when(F.col("first") == F.col("last"), F.format_string("[%d]", "first")).otherwise(
        F.format_string("[%d-%d]", "first", "last"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("text")))),
                        lambda e: e.getField("text"))
    return islands.groupBy(*([by] if by else [])).agg(F.array_join(parts, " ∪ ").alias("text"))


def is_consecutive(df: DataFrame, column: str) -> DataFrame:
    """One row: are the values a run of consecutive integers without repeats?"""
    v = F.col(f"`{column}`").cast("bigint")
    per_value = df.select(v.alias("v")).groupBy("v").count()
    return per_value.agg(
        F.coalesce((F.max("v") - F.min("v") + 1 == F.count("v"))
                   & (F.max(F.when(F.col("v").isNotNull(), F.col("count"))) == 1)
                   & (F.count(F.when(F.col("v").isNull(), 1)) == 0), F.lit(False)).alias("is_consecutive"))


def sort_table(df: DataFrame, by: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    flags = ascending if isinstance(ascending, list) else [ascending] * len(by)
    order: list[Column] = [
        F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in zip(by, flags, strict=True)]
    return df.orderBy(*order)
