"""Ordered computations without a single-task window.

Values are put into at most ``BUCKETS`` quantile ranges per key.  A window over
the bucket totals (a bounded number of rows) gives each bucket its start value;
inside a bucket a partitioned window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


def range_splits(df: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per key with at most ``buckets`` ordered split points."""
    steps = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    return df.groupBy(key).agg(
        F.expr(f"array_distinct(percentile_approx({value}, array({steps}), 10000))").alias("splits"))


def with_buckets(df: DataFrame, key: str, splits: DataFrame | None, **values: str) -> DataFrame:
    """Add bucket columns, e.g. ``bucket='r'``; one bucket if ``splits`` is None."""
    if splits is None:
        return df.selectExpr("*", *[f"0 AS {name}" for name in values])
    found = df.join(F.broadcast(splits), key)
    return found.selectExpr("*", *[
        f"size(filter(splits, s -> s < {v})) AS {name}" for name, v in values.items()]).drop("splits")


def exact_medians(hist: DataFrame, small: bool = False) -> DataFrame:
    """Interpolated median per ``attr`` of a histogram ``(attr, part, value, cnt)``.

    ``part`` orders before ``value``; rows of part -1 and 1 are only counted.
    A ``small`` histogram is ranked without buckets.
    """
    if small:
        whole = Window.partitionBy("attr")
        upto = F.sum("cnt").over(whole.orderBy("part", "value"))
        ranked = (hist.withColumns({"hi": upto, "total": F.sum("cnt").over(whole)})
                  .withColumns({"lo": F.col("hi") - F.col("cnt"), "k1": F.floor((F.col("total") - 1) / 2),
                                "k2": F.ceil((F.col("total") - 1) / 2)}))
        return _middle(ranked)
    splits = range_splits(hist.filter("part = 0"), "attr", "value")
    h = with_buckets(hist, "attr", splits, bucket="value")
    by_bucket = Window.partitionBy("attr").orderBy("part", "bucket")
    whole = Window.partitionBy("attr")
    totals = (h.groupBy("attr", "part", "bucket").agg(F.sum("cnt").alias("n"))
              .withColumn("upto", F.sum("n").over(by_bucket))
              .withColumn("total", F.sum("n").over(whole))
              .withColumn("start", F.col("upto") - F.col("n"))
              .withColumn("k1", F.floor((F.col("total") - 1) / 2))
              .withColumn("k2", F.ceil((F.col("total") - 1) / 2))
              .filter((F.col("start") <= F.col("k2")) & (F.col("upto") > F.col("k1")))
              .select("attr", "part", "bucket", "start", "k1", "k2"))
    inside = Window.partitionBy("attr", "part", "bucket").orderBy("value")
    ranked = (h.join(F.broadcast(totals), ["attr", "part", "bucket"])
              .withColumn("hi", F.col("start") + F.sum("cnt").over(inside))
              .withColumn("lo", F.col("hi") - F.col("cnt")))

    return _middle(ranked)


def _middle(ranked: DataFrame) -> DataFrame:
    """Mean of the values at ranks ``k1`` and ``k2``; a row covers [lo, hi)."""
    def at(k: str) -> Column:
        return F.max(F.when((F.col("lo") <= F.col(k)) & (F.col(k) < F.col("hi")), F.col("value")))

    return ranked.groupBy("attr").agg(at("k1").alias("v1"), at("k2").alias("v2")).select(
        "attr", ((F.col("v1") + F.col("v2")) / 2).alias("median"))


def minima_above(df: DataFrame, key: str, level: str, values: list[str],
                 splits: DataFrame | None) -> DataFrame:
    """For each (key, level): minima of ``values`` over all rows of higher level.

    Columns ``min_<v>`` hold the minima of the row's own level, ``above_<v>``
    those of the higher levels (+inf at the top).
    """
    levels = df.groupBy(key, level).agg(*[F.min(v).alias(f"min_{v}") for v in values])
    levels = with_buckets(levels, key, splits, bucket=level)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    inside = f"(PARTITION BY {key}, bucket ORDER BY {level} DESC {before})"
    own = [f"min_{v}" for v in values]
    near = {v: f"coalesce(min(min_{v}) OVER {inside}, double('inf'))" for v in values}
    if splits is None:
        return levels.selectExpr(key, level, *own, *[f"{near[v]} AS above_{v}" for v in values])
    higher = f"(PARTITION BY {key} ORDER BY bucket DESC {before})"
    tops = (levels.groupBy(key, "bucket").agg(*[F.min(f"min_{v}").alias(f"m_{v}") for v in values])
            .selectExpr(key, "bucket", *[f"min(m_{v}) OVER {higher} AS top_{v}" for v in values]))
    return levels.join(tops, [key, "bucket"]).selectExpr(
        key, level, *own,
        *[f"least({near[v]}, coalesce(top_{v}, double('inf'))) AS above_{v}" for v in values])
