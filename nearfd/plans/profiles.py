"""Summary tables of the star schema on which dependencies are looked for.

A profile folds a whole fact table into few rows, one per combination of small
dimensions, so pairing its rows costs the same at any scale.  Measures are exact
integers: sums of whole units, divided by counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_mean(column: str) -> Column:
    """Floor of the mean of the whole parts."""
    return F.expr(f"sum(cast(floor({column}) as bigint)) div count(1)")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year, priority and status."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.year("o_orderdate").alias("order_year"), F.col("o_orderpriority").alias("priority"),
                     F.col("o_orderstatus").alias("status"))
            .agg(F.count("*").alias("n_orders"), whole_mean("o_totalprice").alias("avg_price")))


def part_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts per brand and type."""
    return (table(spark, sf_dir, "part")
            .groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
            .agg(F.count("*").alias("n_parts"), whole_mean("p_size").alias("avg_size"),
                 whole_mean("p_retailprice").alias("avg_price")))


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type; a largest value that is a multiple of 7 counts as unknown."""
    return (table(spark, sf_dir, "events")
            .groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))
            .agg(F.count("*").alias("n_events"),
                 F.expr("cast(floor(max(value)) as bigint)").alias("max_value"))
            .withColumn("max_value", F.expr("nullif(max_value % 7, 0)")))


SHIPPING = {  # 20 measures of a period, SQL that Spark and others read alike
    "n_items": "count(*)", "lines": "sum(cast(l_linenumber AS bigint))", "most_part": "max(l_partkey)",
    "most_supplier": "max(l_suppkey)", "quantity": "sum(cast(l_quantity AS bigint))",
    "least_quantity": "min(cast(l_quantity AS bigint))", "most_quantity": "max(cast(l_quantity AS bigint))",
    "price": "sum(cast(floor(l_extendedprice) AS bigint))", "least_price": "min(cast(floor(l_extendedprice) AS bigint))",
    "most_price": "max(cast(floor(l_extendedprice) AS bigint))", "least_order": "min(l_orderkey)", "most_order": "max(l_orderkey)",
    "untaxed": "sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END)", "reduced": "nullif(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) % 5, 0)",
    "accepted": "sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)", "returned": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)",
    "open": "sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", "first_lines": "sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)",
    "flags": "concat('R', cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 97 AS string))", "first_day": "min(cast(l_shipdate AS date))",
}


def shipping_profile(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Line items per ``period`` ('month', 'quarter') of shipping: a wide table of few rows."""
    return (table(spark, sf_dir, "lineitem").groupBy(F.date_trunc(period, "l_shipdate").alias("_period"))
            .agg(*[F.expr(e).alias(c) for c, e in SHIPPING.items()]).drop("_period"))
