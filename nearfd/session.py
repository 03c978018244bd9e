"""Shared folders and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame
from pyspark.sql.types import StructType

_fallback_dir: str | None = None


def shared_dir(spark: SparkSession, name: str = "run") -> str:
    """A new path inside the cluster's shared folder.

    That is ``spark.checkpoint.dir`` or else the context's checkpoint folder.  Only a local session without either, as
    in tests, gets a temporary folder; on several machines each would see its own part of it, so that is an error.
    """
    global _fallback_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _fallback_dir is None:
            _fallback_dir = tempfile.mkdtemp(prefix="nearfd-")
        base = _fallback_dir
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute, exact size statistics for the
    optimizer and column pruning for every later reader.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Later(ClassicDataFrame):
    """A frame of a known schema that ``make`` makes when its rows or plan are first asked for."""

    def __new__(cls, spark: SparkSession, schema: StructType, make):
        return object.__new__(cls)

    def __init__(self, spark: SparkSession, schema: StructType, make) -> None:
        self._make, self._made = make, None
        super().__init__(None, spark)
        self.__dict__["schema"] = schema

    @property
    def _jdf(self):
        if self._made is None:
            self._made = self._make()
        return self._made._jdf

    @_jdf.setter
    def _jdf(self, value) -> None:
        """The base class sets it before there is one."""

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def is_made(self) -> bool:
        return self._made is not None


def mark_stored(df: DataFrame) -> DataFrame:
    """Say that ``df`` only reads a written table, row by row: reading it again costs little."""
    df._nearfd_stored = True
    return df


def is_stored(df: DataFrame) -> bool:
    return getattr(df, "_nearfd_stored", False)
