"""Run metrics as tables."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: columns of a run record
RUN_SCHEMA = T.StructType([
    T.StructField("ds_name", T.StringType()),
    T.StructField("ds_len", T.LongType()),
    T.StructField("ds_attr_size", T.IntegerType()),
    T.StructField("ds_file_size_B", T.LongType()),
    T.StructField("time_elapsed", T.DoubleType()),
    T.StructField("distance_time", T.DoubleType()),
    T.StructField("rfd_count", T.LongType()),
    T.StructField("attr_comb", T.StringType()),
    T.StructField("iterations", T.IntegerType()),
])


def measure_discovery(spark: SparkSession, path: str, name: str, attrs: list[str] | None = None,
                      **read_options) -> DataFrame:
    """Read a CSV table, discover each right side and record size, times (ms) and
    number of dependencies per combination of sides."""
    from ..operators.discover import discover
    from ..operators.pairs import pair_distances, side_combinations
    from ..session import materialize
    from ..sources.tables import read_table

    df = read_table(spark, path, **read_options)
    attrs = attrs or df.columns
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    rows = df.count()
    start = time.perf_counter()
    pairs = materialize(pair_distances(df, attrs), "pairs")
    distance_ms = (time.perf_counter() - start) * 1000
    runs = []
    for rhs, lhs in side_combinations(list(attrs)):
        start = time.perf_counter()
        found = discover(pairs, rhs, lhs, stored=True).count()
        runs.append({
            "ds_name": name, "ds_len": rows, "ds_attr_size": len(attrs), "ds_file_size_B": size,
            "time_elapsed": (time.perf_counter() - start) * 1000, "distance_time": distance_ms, "rfd_count": found,
            "attr_comb": json.dumps({"rhs": [rhs], "lhs": lhs}), "iterations": 1})
    return bench_results(spark, runs)


def bench_results(spark: SparkSession, runs: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in RUN_SCHEMA) for r in runs], RUN_SCHEMA)


def append_results(results: DataFrame, path: str, decimal_comma: bool = True) -> None:
    """Append run records to a CSV folder, by default with decimal commas."""
    out = results
    if decimal_comma:
        out = results.select(*[
            F.replace(F.col(f.name).cast("string"), F.lit("."), F.lit(",")).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in results.schema])
    out.write.mode("append").option("sep", ";").option("header", True).csv(path)


def bench_summary(results: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Mean of each value per group."""
    return results.groupBy(by).agg(*[F.avg(F.col(f"`{v}`")).alias(v) for v in values])
