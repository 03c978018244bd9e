"""Token counts of documents from flat token files that have no index.

A flat file is nothing but token ids of a fixed width, one document after the other, each closed by an
end-of-document id.  ``scan`` cuts files into blocks of equal size, finds the separators of every block with one
vectorised search, and stitches documents that cross blocks with a prefix scan over the blocks: the number of
separators and the last separator before each block.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, shared_dir

BLOCK_BYTES = 8 << 20
GROUP = 1024  # blocks of one window of the prefix scan


def tokenizer(path: str, pattern: str) -> Callable[[], Callable[[str], list[int]]]:
    """Maker of an encoder from a public rank file and its split pattern; called once per task."""
    def make() -> Callable[[str], list[int]]:
        import tiktoken

        file_system, name = fs.FileSystem.from_uri(path)
        with file_system.open_input_stream(name) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def write_flat(docs: DataFrame, folder: str, encoder: Callable, eod: int, dtype: str = "uint16",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file per task into a shared ``folder``; returns ``path, first, ids``: the ids of the
    documents of a file in its order, in pieces that begin at document number ``first``.

    A failed attempt leaves a file that no returned row names.  A null text is a document without tokens.
    """
    def run(batches):
        file_system, where = fs.FileSystem.from_uri(folder)
        out = path = None
        encode, kind, end, n = encoder(), np.dtype(dtype), np.array([eod], dtype).tobytes(), 0
        for batch in batches:
            if out is None:
                file_system.create_dir(where, recursive=True)
                name = f"{uuid.uuid4().hex}.bin"
                path, out = f"{folder.rstrip('/')}/{name}", file_system.open_output_stream(f"{where.rstrip('/')}/{name}")
            for text in batch.column(1):
                text = text.as_py()
                if text:
                    out.write(np.array(encode(text), kind).tobytes())
                out.write(end)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))],
                names=["path", "first", "ids"])
            n += batch.num_rows
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "path string, first long, ids array<long>"), "manifest")


def file_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, block, offset, size`` of all blocks of the files of a folder; only their sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / block_bytes)).cast("long")
    return (files.select("path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
            .select("path", "block", (F.col("block") * block_bytes).alias("offset"),
                    F.least(F.lit(block_bytes), F.col("length") - F.col("block") * block_bytes).alias("size")))


def scan(blocks: DataFrame, eod: int, dtype: str = "uint16") -> DataFrame:
    """``path, ordinal, start, n_tokens, closed``: every document of every file, positions counted in tokens.

    ``closed`` is false for tokens after a file's last separator.  Two separators in a row hold an empty document;
    an empty file holds none.  A file whose length is no multiple of the token width raises an error, as does a
    block size that is none.  Memory is one block; a document may span any number of blocks.
    """
    width = np.dtype(dtype).itemsize

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] % width or row["offset"] % width:
                    raise ValueError(f"{row['path']}: not a whole number of {dtype} tokens")
                file_system, name = fs.FileSystem.from_uri(row["path"])
                with file_system.open_input_file(name) as f:
                    raw = f.read_at(row["size"], row["offset"])
                at = np.flatnonzero(np.frombuffer(raw, dtype) == eod) + row["offset"] // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int64()),
                     pa.array([(row["offset"] + row["size"]) // width], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    names=["path", "block", "stop", "at"])

    spread = blocks.repartition(F.col("path"), F.col("block"))
    found = materialize(spread.mapInArrow(find, "path string, block long, stop long, at array<long>"), "separators")
    # prefix scan in two steps, so that no window holds more than GROUP blocks or the groups of one file
    ends = found.select("path", "block", "stop", F.floor(F.col("block") / GROUP).alias("group"),
                        F.size("at").cast("long").alias("n"), F.expr("get(at, size(at) - 1)").alias("last"))
    before = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (ends.groupBy("path", "group").agg(F.sum("n").alias("gn"), F.max("last").alias("glast"))
              .select("path", "group", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("g_seen"),
                      F.coalesce(F.max("glast").over(before), F.lit(-1)).alias("g_last")))
    inner = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "group", "block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("b_seen"),
                          F.max("last").over(inner).alias("b_last")).join(groups, ["path", "group"])
    carry = carried.select("path", "block", (F.col("g_seen") + F.col("b_seen")).alias("seen"),
                           F.greatest(F.coalesce("b_last", F.lit(-1)), F.col("g_last")).alias("last"))
    stitched = found.join(carry, ["path", "block"])
    docs = stitched.select("path", "seen", "last", "at", F.posexplode("at").alias("i", "end")).select(
        "path", (F.col("seen") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") > 0, F.expr("get(at, i - 1)")).otherwise(F.col("last")) + 1).alias("start"), "end", F.lit(True).alias("closed"))
    tail = found.groupBy("path").agg(F.max("stop").alias("end"), F.sum(F.size("at").cast("long")).alias("ordinal"),
                                     (F.coalesce(F.max(F.expr("get(at, size(at) - 1)")), F.lit(-1)) + 1).alias("start"))
    tail = tail.filter("start < end").select("path", "ordinal", "start", "end", F.lit(False).alias("closed"))
    return docs.unionByName(tail).select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def token_counts(docs: DataFrame, encoder: Callable, eod: int, dtype: str = "uint16", id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, n_tokens``: documents written to flat files and counted by scanning these, one row per input row.

    Null ids and repeated rows stay as they are; null and empty texts have 0 tokens.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    manifest = write_flat(docs, folder, encoder, eod, dtype, id_col, text_col)
    if manifest.isEmpty():
        return manifest.select(F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_tokens")).limit(0)
    # files of failed attempts are in the folder too: only named ones are scanned
    name = F.element_at(F.split("path", "/"), -1)
    named = manifest.select(name.alias("file")).distinct()
    blocks = file_blocks(docs.sparkSession, folder, block_bytes).withColumn("file", name).join(named, "file", "left_semi")
    counts = scan(blocks.drop("file"), eod, dtype).filter("closed").select(name.alias("file"), "ordinal", "n_tokens")
    ids = manifest.select(name.alias("file"), "first", F.posexplode("ids").alias("i", "doc_id")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["file", "ordinal"]).select(F.col("doc_id").alias(id_col), "n_tokens")
