"""Windowed top-k over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# fixed values: fields of an incoming message
MESSAGE_SCHEMA = T.StructType([
    T.StructField("created_at", T.StringType()),
    T.StructField("sentiment_word_count", T.IntegerType()),
    T.StructField("sentiment_comparative", T.DoubleType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("sentiment_positive_count", T.IntegerType()),
    T.StructField("sentiment_tokens", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("_msgid", T.StringType()),
    T.StructField("retweet_count", T.IntegerType()),
    T.StructField("sentiment_negative_count", T.IntegerType()),
])


def stream_source(spark: SparkSession, path: str, schema: T.StructType | str = MESSAGE_SCHEMA,
                  format: str = "json", file_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Unbounded table over a folder that keeps receiving files."""
    reader = spark.readStream.schema(schema).format(format)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse_messages(raw: DataFrame, column: str = "value", schema: T.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Fixed columns from JSON text; newlines in ``text`` are escaped."""
    parsed = raw.select(F.from_json(F.col(column), schema).alias("m")).select("m.*")
    return parsed.withColumn("text", escape_newlines(F.col("text")))


def escape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def list_size(c: Column) -> Column:
    """Number of elements, 0 for a missing list."""
    return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))


def stream_project(messages: DataFrame, columns: dict[str, Column], keep: Column,
                   where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Filter, project, then part into kept and rejected rows.

    ``keep`` is evaluated on the projected columns; a NULL result rejects.
    """
    rows = messages if where is None else messages.filter(where)
    rows = rows.select(*[c.alias(n) for n, c in columns.items()])
    good = F.coalesce(keep, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def divert_stream(messages: DataFrame, columns: dict[str, Column], keep: Column, path: str, checkpoint: str,
                  where: Column | None = None, once: bool = True, every: str = "10 minutes"):
    """Start parting a stream into the folders ``path/part=kept`` and ``path/part=rejected``, reading it once.

    Each batch is one write, dealt by whether ``keep`` (on the projected columns; NULL rejects) holds, into folders
    of its own number.  A batch that is tried again replaces these folders, so nothing is written twice, whatever
    failed before.  ``once`` works off what is there and stops, otherwise it triggers ``every``.
    """
    part = F.when(F.coalesce(keep, F.lit(False)), F.lit("kept")).otherwise(F.lit("rejected"))
    rows = messages if where is None else messages.filter(where)
    rows = rows.select(*[c.alias(n) for n, c in columns.items()]).withColumn("part", part)

    def write(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part", "batch").parquet(path))

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def diverted(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``divert_stream`` wrote: its columns by ``schema``, and ``part`` ('kept' or 'rejected')."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([*wanted.fields, T.StructField("part", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path).drop("batch")


def tweet_fields() -> dict[str, Column]:
    """Projection of a scored message; list columns become counts."""
    # fixed values: names of the projected fields
    return {
        "created_at": F.col("tweet.created_at"),
        "text": F.col("tweet.text"),
        "retweet_count": F.col("tweet.retweet_count"),
        "favourite_count": F.col("tweet.favourite_count"),
        "sentiment_score": F.col("sentiment.score"),
        "sentiment_tokens": list_size(F.col("sentiment.tokens")),
        "sentiment_comparative": F.col("sentiment.comparative") * 100,
        "sentiment_positive_count": list_size(F.col("sentiment.positive")),
        "sentiment_negative_count": list_size(F.col("sentiment.negative")),
        "sentiment_word_count": list_size(F.col("sentiment.words")),
    }


WINDOWS_PER_GROUP = 64


def _places(table: pa.Table) -> np.ndarray:
    """Position of each row inside its window, from 0; rows lie window by window."""
    ends = table["_end_ms"].to_numpy()
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    return np.arange(len(ends)) - np.repeat(starts, np.diff(np.append(starts, len(ends))))


def _best(tables: list[pa.Table], by: list[str], k: int) -> pa.Table:
    """The k largest rows of each window in the order of Spark's ``desc``: NaN first, null last."""
    table = pa.concat_tables(tables)
    order = pa.table({"_end_ms": table["_end_ms"]})
    for i, c in enumerate(by):
        if pa.types.is_floating(table.schema.field(c).type):
            order = order.append_column(f"nan{i}", pc.cast(pc.is_nan(table[c]), pa.int8()))
        order = order.append_column(f"key{i}", table[c])
    sorting = [(c, "ascending" if c == "_end_ms" else "descending") for c in order.column_names]
    table = table.take(pc.sort_indices(order, sort_keys=sorting, null_placement="at_end"))
    return table.filter(pa.array(_places(table) < k))


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def stream_topk(sdf: DataFrame, ts: str, keys: list[str], k: int = 5, window: str = "10 minutes",
                watermark: str = "10 minutes", text_cols: list[str] | tuple = ()) -> DataFrame:
    """The ``k`` largest rows by ``keys`` of each tumbling event-time window.

    Works on streams (append mode: a window is emitted once the watermark has
    passed its end; later rows are dropped) and on static tables.  Every task
    first cuts its batch to ``k`` rows per window, so a busy window reaches its
    state as few rows, and the state never holds more than ``k`` rows per open
    window.  Neighbouring windows share a state, so a backlog of many windows
    does not pay for each of them.
    Make the last key unique to get a fixed order of ties.
    """
    rows = sdf
    for c in text_cols:
        rows = rows.withColumn(c, escape_newlines(F.col(f"`{c}`")))
    cols = sdf.columns
    if not sdf.isStreaming:
        return _batch_topk(rows, ts, keys, k, window)
    rows = rows.withWatermark(ts, watermark)
    span = F.window(F.col(f"`{ts}`"), window)
    start, end = F.unix_millis(span.getField("start")), F.unix_millis(span.getField("end"))
    rows = rows.select(span.getField("start").alias("window_start"), span.getField("end").alias("window_end"),
                       end.alias("_end_ms"), F.floor(start / ((end - start) * WINDOWS_PER_GROUP)).alias("_group"),
                       *[F.col(f"`{c}`") for c in cols])
    names = ["window_start", "window_end", *cols]
    # rows travel and are held as Arrow bytes, so no value changes its type; the end of the newest window is
    # the event time of such a packet, which drops it only when all of its windows are closed
    packet = T.StructType([T.StructField("_group", T.LongType()), T.StructField("rows", T.BinaryType()),
                           T.StructField("seen", rows.schema["window_end"].dataType, True, rows.schema[ts].metadata)])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            best = _best([new] if best is None else [best, new], keys, k)
        for group in [] if best is None else pc.unique(best["_group"]).to_pylist():
            part = best.filter(pc.equal(best["_group"], group))
            seen = pa.array([pc.max(part["window_end"]).as_py()], part.schema.field("window_end").type)
            yield pa.record_batch([pa.array([group], pa.int64()), pa.array([_pack(part)], pa.binary()), seen],
                                  names=packet.names)

    def per_group(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Open windows of one group: k rows each; closed ones are emitted."""
        held = _unpack(state.get[0]) if state.exists else None
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new = [_unpack(data) for pdf in batches for data in pdf["rows"]]
            new = [t.filter(pc.greater(t["_end_ms"], now)) for t in new]  # later rows find their window closed
            new = [t for t in new if len(t)]
            if new:
                held = _best(new if held is None else [held, *new], keys, k)
        if held is None:
            return
        closed = held.filter(pc.less_equal(held["_end_ms"], now))
        held = held.filter(pc.greater(held["_end_ms"], now))
        if len(held):
            state.update((_pack(held),))
            state.setTimeoutTimestamp(pc.min(held["_end_ms"]).as_py())
        elif state.exists:
            state.remove()
        if len(closed):
            yield pd.DataFrame({"rows": [_pack(closed)]})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                table = _unpack(data)
                rank = pa.array(_places(table) + 1, pa.int32())
                yield from table.select(names).append_column("rank", rank).to_batches()

    out = T.StructType([*[rows.schema[c] for c in names], T.StructField("rank", T.IntegerType())])
    return (rows.mapInArrow(per_task, schema=packet).groupBy("_group")
            .applyInPandasWithState(per_group, "rows binary", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
            .mapInArrow(opened, schema=out))


def _batch_topk(df: DataFrame, ts: str, keys: list[str], k: int, window: str) -> DataFrame:
    span = F.window(F.col(f"`{ts}`"), window)
    rows = df.select(span.getField("start").alias("window_start"), span.getField("end").alias("window_end"), "*")
    # the planner cuts every task to k rows per window before the shuffle
    order = Window.partitionBy("window_start").orderBy(*[F.desc(c) for c in keys])
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def write_stream(sdf: DataFrame, path: str, checkpoint: str, format: str = "parquet",
                 once: bool = True, every: str = "10 minutes"):
    """Start appending a stream to files; the checkpoint makes it restartable.

    ``once`` works off what is there and stops, otherwise it triggers ``every``.
    """
    writer = sdf.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    if format == "csv":
        writer = writer.option("sep", ";").option("header", True)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start(path)
