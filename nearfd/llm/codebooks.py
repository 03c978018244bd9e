"""Vector codes from part codebooks, with distances read from per-dimension value dictionaries.

1. Components become integers.  Slices of rows are dictionary-encoded once: per dimension the distinct integers of the
   slice, and for every row the place of its integer.  Slices are written to the shared folder and read by every pass.
2. A pass tabulates, per dimension, the squared difference of every distinct integer to every codebook entry.  The
   distance of a part to all entries then is a sum of gathers from these tables; no vector is subtracted from an entry.
3. Training passes send only sums per part, entry and component to the driver (entries x dimensions numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

SLICE_CELLS = 1 << 18  # rows times dimensions of a slice
LIMIT = 1 << 27  # squares of differences of larger components would leave 64 bits


@dataclass(frozen=True)
class Codes:
    """``scale`` turns components into integers; ``parts`` equal consecutive parts (the first ones one longer if the
    length is no multiple); ``entries`` of each codebook, two hexadecimal digits name one, so 256 at most."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256

    def __post_init__(self) -> None:
        if not 1 <= self.entries <= 256:
            raise ValueError("entries must be 1 to 256")


def whole_vector(vec: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def int_vector(vec: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, at most ``LIMIT`` from zero."""
    return F.transform(vec, lambda x: F.least(F.greatest(
        F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))


def _slices(dims: int, id_type: pa.DataType, label_type: pa.DataType):
    step = max(1, SLICE_CELLS // max(dims, 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows = part.column("v").flatten().to_numpy().reshape(part.num_rows, dims)
                pairs = [np.unique(rows[:, d], return_inverse=True) for d in range(dims)]
                sizes = np.cumsum([0, *(len(u) for u, _ in pairs)])
                codes = np.stack([c.ravel() for _, c in pairs], axis=1) if dims else np.zeros((part.num_rows, 0))
                values = np.concatenate([u for u, _ in pairs]) if dims else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(id_type)), pa.array([part.column("label").to_pylist()], pa.list_(label_type)),
                     pa.array([values], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                     pa.array([codes.astype("<u4").tobytes()], pa.binary())],
                    names=["ids", "labels", "dictionary", "offsets", "codes"])

    return encode


def part_bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    """First and last dimension (exclusive) of every part."""
    ends = np.cumsum([dims // parts + (p < dims % parts) for p in range(parts)])
    return [(int(e - (dims // parts + (p < dims % parts))), int(e)) for p, e in enumerate(ends)]


def part_distances(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row's part to every entry: one table per dimension, then gathers and adds."""
    widest = max((int(np.abs(v).max()) for v in (*values, book) if v.size), default=0)
    small = 4 * widest * widest * max(len(values), 1) < 2**31
    kind = np.int32 if small else np.int64
    out = np.zeros((len(codes), len(book)), kind)
    for d, v in enumerate(values):
        table = (v.astype(kind)[:, None] - book[None, :, d].astype(kind)) ** 2
        out += table[codes[:, d]]
    return out


def _encoded(batch: pa.RecordBatch):
    """(ids, labels, distinct values per dimension, codes) of every slice of a batch."""
    for i in range(batch.num_rows):
        offsets = batch.column("offsets")[i].values.to_numpy()
        values = batch.column("dictionary")[i].values.to_numpy()
        ids = batch.column("ids")[i].values
        codes = np.frombuffer(batch.column("codes")[i].as_py(), "<u4").reshape(len(ids), len(offsets) - 1)
        yield ids, batch.column("labels")[i].values, [values[a:b] for a, b in zip(offsets, offsets[1:])], codes


def _sums(books: list[np.ndarray], bounds: list[tuple[int, int]]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, _, values, codes in _encoded(batch):
                for p, (lo, hi) in enumerate(bounds):
                    entry = part_distances(values[lo:hi], codes[:, lo:hi], books[p]).argmin(1)
                    counts[p] += np.bincount(entry, minlength=len(books[p]))
                    for d in range(lo, hi):
                        np.add.at(sums[p][:, d - lo], entry, values[d][codes[:, d]])
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]),
                    pa.array(list(sums[p][used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return add


def _assigned(books: list[np.ndarray], bounds: list[tuple[int, int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, values, codes in _encoded(batch):
                best = np.zeros((len(codes), len(bounds)), np.uint8)
                error = np.zeros(len(codes), np.int64)
                for p, (lo, hi) in enumerate(bounds):
                    far = part_distances(values[lo:hi], codes[:, lo:hi], books[p])
                    best[:, p] = far.argmin(1)
                    error += far[np.arange(len(far)), best[:, p]]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([r.tobytes().hex() for r in best], pa.string()), pa.array(error)],
                    names=["id", "label", "code", "error"])

    return assign


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     cfg: Codes = Codes()) -> tuple[DataFrame, list[np.ndarray]]:
    """``id_col, label, code, error`` of every whole vector, and the codebook (entries x width) of every part.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors that have not
    the length most vectors have (the longer one of equally frequent lengths).  Codebooks start from the smallest ids
    (nulls last, of equal ids the smaller vector); with fewer rows than ``entries`` they are shorter.  Repeated rows
    and null ids each keep a row.  Components beyond 2**27 after scaling count as 2**27.  Empty tables give an empty
    table and no entries.  Other columns play no part.
    """
    kept = df.filter(whole_vector(F.col(vec_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), int_vector(F.col(vec_col), cfg.scale).alias("v"))
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims = lengths[0].n if lengths else 0
    kept = kept.filter(F.size("v") == dims)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(cfg.entries).select("v").collect()
    bounds = part_bounds(dims, cfg.parts)
    start = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    books = [start[:, lo:hi].copy() for lo, hi in bounds]

    kinds = {f.name: f.dataType for f in kept.schema.fields}
    arrow = kept.limit(0).select("id", "label").toArrow().schema
    coded = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
                          T.StructField("dictionary", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())),
                          T.StructField("codes", T.BinaryType())])
    slices = materialize(kept.mapInArrow(_slices(dims, arrow.field("id").type, arrow.field("label").type), coded), "slices")
    for _ in range(cfg.rounds if len(start) else 0):
        parts = slices.mapInArrow(_sums(books, bounds), "part int, entry int, n long, sums array<long>")
        total = parts.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in total.collect():  # entries x dimensions rows at most
            books[r.part][r.entry, r.pos] = r.s // r.n
    out = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    codes = slices.mapInArrow(_assigned(books, bounds), out)
    return codes.withColumnRenamed("id", id_col), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cfg: Codes = Codes()) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256``: ``compress_vectors`` with the error of all rows that
    have the same label (nulls together)."""
    codes, books = compress_vectors(df, id_col, vec_col, label_col, cfg)
    codes = materialize(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        id_col, "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def codes_sql(cfg: Codes = Codes()) -> str:
    """DuckDB SQL for ``vector_codes`` on the table ``embeddings`` (lengths that are multiples of ``parts``)."""
    far = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({cfg.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""v AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {cfg.parts}) + 1:(p + 1) * (len(v) // {cfg.parts})] AS x
  FROM k, unnest(generate_series(0, {cfg.parts - 1})) AS t(p))""",
            f"""b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v
  QUALIFY e < {cfg.entries})"""]
    for n in range(cfg.rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT v.vec_id, v.label, v.p, any_value(v.x) AS x, arg_min(b.e, ({far}) * {cfg.entries} + b.e) AS e, min({far}) AS far
  FROM v JOIN b{n} b ON b.p = v.p GROUP BY v.vec_id, v.label, v.p)""")
        if n < cfg.rounds:
            ctes.append(f"""u{n} AS (SELECT p, e, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS m FROM a{n}, unnest(generate_series(1, len(x))) AS t(i) GROUP BY p, e, i) GROUP BY p, e)""")
            ctes.append(f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{n} b LEFT JOIN u{n} u ON u.p = b.p AND u.e = b.e)")
    n = cfg.rounds
    return "WITH " + ",\n".join(ctes) + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{n} GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{n})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s"""
