"""Reading, writing and profiling tables."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize

SNIFF_LINES = 32


@dataclass(frozen=True)
class Dialect:
    sep: str
    header: bool


def _cells(line: str, sep: str) -> list[str]:
    cells, quoted, start = [], False, 0
    for i, ch in enumerate(line):
        if ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            cells.append(line[start:i])
            start = i + 1
    return [c.strip().strip('"') for c in [*cells, line[start:]]]


def _is_number(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def sniff_csv(spark: SparkSession, path: str, candidates: str = ",;|\t", null: str = "?") -> Dialect:
    """Delimiter and header of a CSV file from its first lines.

    The delimiter is the one with the same positive count on most lines.  The
    first line is a header if a column's type differs from the lines below, or if
    everything is text.  The first ``SNIFF_LINES`` lines decide only this dialect.
    """
    lines = [r["value"] for r in spark.read.text(path).head(SNIFF_LINES) if r["value"].strip()]
    if not lines:
        raise ValueError(f"{path} is empty")
    ranked = []
    for pos, sep in enumerate(candidates):
        counts = Counter(len(_cells(line, sep)) - 1 for line in lines)
        n, lines_n = counts.most_common(1)[0]
        ranked.append((lines_n if n else 0, n, -pos, sep))
    sep = max(ranked)[3]
    rows = [_cells(line, sep) for line in lines]
    first, rest = rows[0], rows[1:]
    differs, text_only = False, True
    for i, name in enumerate(first):
        below = [r[i] for r in rest if i < len(r) and r[i] not in ("", null)]
        numbers = bool(below) and all(map(_is_number, below))
        differs = differs or (bool(below) and numbers != _is_number(name))
        text_only = text_only and not numbers and not _is_number(name)
    return Dialect(sep, differs or text_only)


def read_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    header: bool | None = None,
    null: str = "?",
    date_cols: list[str] | tuple = (),
    date_format: str | None = None,
    id_col: str | None = None,
    schema: T.StructType | str | None = None,
    header_rows: int = 1,
    skip_blanks: bool = False,
) -> DataFrame:
    """Read a CSV table; unknown separator or header are inferred.

    Empty cells and ``null`` become NULL.  ``date_cols`` become timestamps.
    ``id_col`` names an existing key, or a new dense ``row id`` column if the
    file has no such column.  ``header_rows=2`` joins two header lines to
    ``name|role``.  ``skip_blanks`` drops blanks around values.
    """
    if sep is None or (header is None and header_rows == 1):
        guess = sniff_csv(spark, path, null=null)
        sep = sep or guess.sep
        header = guess.header if header is None else header
    if header_rows == 2:
        df = _two_headers(spark, path, sep, null, schema)
    else:
        reader = (spark.read.option("sep", sep).option("header", bool(header)).option("nullValue", null)
                  .option("ignoreLeadingWhiteSpace", skip_blanks).option("ignoreTrailingWhiteSpace", skip_blanks))
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    changes: dict[str, Column] = {}
    for c in strings:
        v = F.col(f"`{c}`")
        v = F.nullif(F.nullif(v, F.lit("")), F.lit(null))
        changes[c] = F.try_to_timestamp(v, F.lit(date_format) if date_format else None) if c in date_cols else v
    for c in date_cols:
        if c not in strings:
            changes[c] = F.col(f"`{c}`").cast("timestamp")
    df = df.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return with_row_id(df, id_col) if id_col and id_col not in df.columns else df


def _two_headers(spark, path, sep, null, schema) -> DataFrame:
    """Cells below the first two lines of each file; equal lines further down are data."""
    heads = [_cells(r["value"], sep) for r in spark.read.text(path).head(2)]
    names = [f"{a}|{b}" for a, b in zip(*heads, strict=True)]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    lines = materialize(lines, "lines")  # stored first: a second evaluation could number the lines differently
    # each task cuts its part to two lines per file before the shuffle
    first = Window.partitionBy("file").orderBy("start", "place")
    top = (lines.select("file", "start", "place").withColumn("n", F.row_number().over(first))
           .filter("n <= 2").select("place"))
    body = lines.join(top, "place", "left_anti").filter(F.trim("value") != "")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = body.select(F.from_csv("value", ddl, {"sep": sep, "nullValue": null}).alias("r")).select("r.*")
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return body.select(*[F.col(f"`{n}`").cast(f.dataType).alias(n)
                             for n, f in zip(names, wanted.fields, strict=True)])
    tests = body.agg(*[F.count(F.when(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("double").isNull(), 1))
                       for n in names]).first()
    return body.select(*[(F.col(f"`{n}`").cast("double") if tests[i] == 0 else F.col(f"`{n}`")).alias(n)
                         for i, n in enumerate(names)])


def columns_with_role(df: DataFrame, role: str) -> DataFrame:
    """Columns of a two-header table whose second header is ``role``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.rsplit("|", 1)[-1] == role])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1 in partition order, without sorting or a single task.

    Each row's place inside its partition is shifted by the sizes of the
    partitions before it; only those sizes (one row per partition) are ordered.
    """
    place = F.monotonically_increasing_id()
    # stored first: a second evaluation could deal the rows differently
    marked = materialize(df.withColumns({"_p": F.shiftright(place, 33), "_i": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_p").count().select(
        F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (marked.join(starts, F.col("_p") == F.col("_q"))
            .select((F.col("_start") + F.col("_i")).alias(name), *[F.col(f"`{c}`") for c in df.columns]))


def write_table(df: DataFrame, path: str, sep: str = ";", null: str = "?", date_format: str | None = None,
                mode: str = "errorifexists") -> None:
    """Write a CSV table with a header; NULL becomes ``null``."""
    writer = (df.write.mode(mode).option("sep", sep).option("header", True).option("nullValue", null)
              .option("encoding", "UTF-8"))
    if date_format:
        writer = writer.option("dateFormat", date_format).option("timestampFormat", date_format)
    writer.csv(path)


def table_profile(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    names = F.lit(",".join(df.columns))
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), names.alias("columns"))
