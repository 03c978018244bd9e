"""Dependency tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rfd import make_rfds, rfds_from_wide, rfds_to_wide

_SIDES = "LHS map<string,double>, RHS map<string,double>"


def write_rfds(rfds: DataFrame, path: str, format: str = "csv", attrs: list[str] | None = None,
               digits: int | None = 2, partition_by: str | None = None, sep: str = ";", null: str = "?",
               mode: str = "errorifexists") -> None:
    """Write dependencies.

    ``csv``: one threshold column per attribute of ``attrs`` and ``RHS``;
    ``json``: objects ``{"LHS": {..}, "RHS": {..}}``; ``parquet``: canonical rows.
    ``partition_by='rhs'`` makes one CSV folder per right side, in which the
    right side's thresholds are the last column and ``key`` is the JSON text of
    the two sides.
    """
    if format == "parquet":
        rfds.write.mode(mode).parquet(path)
    elif format == "json":
        rfds.select(F.col("lhs").alias("LHS"), F.create_map("rhs", "rhs_threshold").alias("RHS")) \
            .write.mode(mode).json(path)
    elif format == "csv":
        if not attrs:
            raise ValueError("the CSV form needs attrs")
        if partition_by == "rhs":
            key = F.to_json(F.struct(F.sort_array(F.map_keys("lhs")).alias("lhs"), F.array("rhs").alias("rhs")))
            thr = [F.element_at("lhs", c) for c in attrs]
            thr = [(t if digits is None else F.bround(t, digits)).alias(c) for t, c in zip(thr, attrs, strict=True)]
            last = F.col("rhs_threshold") if digits is None else F.bround("rhs_threshold", digits)
            wide = rfds.select("rhs", key.alias("key"), *thr, last.alias("threshold"))
            writer = wide.write.partitionBy("rhs")
        elif partition_by is None:
            writer = rfds_to_wide(rfds, attrs, digits).write
        else:
            raise ValueError("partition_by is 'rhs' or None")
        writer.mode(mode).option("sep", sep).option("header", True).option("nullValue", null).csv(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def read_rfds(spark: SparkSession, path: str, format: str = "csv", attrs: list[str] | None = None,
              sep: str = ";", null: str = "?") -> DataFrame:
    """Read dependencies into canonical rows (see ``write_rfds``)."""
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "json":
        raw = spark.read.schema(_SIDES).option("multiLine", False).json(path)
        return _from_sides(raw)
    if format == "json_array":
        return _from_sides(spark.read.schema(_SIDES).option("multiLine", True).json(path))
    if format == "csv":
        if attrs is None:
            head = spark.read.text(path).first()["value"]
            columns = head.split(sep)
        else:
            columns = ["RHS", *attrs]
        schema = T.StructType([
            T.StructField(c, T.StringType() if c == "RHS" else T.DoubleType()) for c in columns])
        wide = (spark.read.schema(schema).option("sep", sep).option("header", True)
                .option("nullValue", null).option("enforceSchema", False).csv(path))
        return rfds_from_wide(wide)
    raise ValueError(f"unknown format {format!r}")


def _from_sides(raw: DataFrame) -> DataFrame:
    rhs = F.element_at(F.map_keys("RHS"), 1)
    thr = F.element_at(F.map_values("RHS"), 1)
    return make_rfds(raw.select(rhs.alias("rhs"), thr.alias("rhs_threshold"), F.col("LHS").alias("lhs")))
