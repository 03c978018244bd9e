"""Pair distances of wide tables: one packed vector per pair instead of one column expression per attribute.

Rows meet in the same bounded cells as in ``pairs``, but a cell is one Arrow kernel that fills a matrix of distances
attribute by attribute and hands on each distinct row of it as ``8 * attributes`` bytes.  The plan has the same few
nodes for two attributes or two hundred; copies of a vector are folded in the cell and then by one grouping on the
packed bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import INF, MICROS_PER_DAY, is_whole, micros
from ..plans.blocks import block_count
from ..session import materialize

PAIRS = 1 << 18  # pairs of one matrix
STRING_PAIRS = 1 << 16  # pairs of strings whose edit distances are computed side by side


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each ``a[i]`` and ``b[i]`` (code points), all pairs side by side in one table."""
    out = np.zeros(len(a), np.float64)
    for lo in range(0, len(a), STRING_PAIRS):
        xs, ys = a[lo:lo + STRING_PAIRS], b[lo:lo + STRING_PAIRS]
        nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
        cx, cy = (_codes(s, n) for s, n in ((xs, nx), (ys, ny)))
        row = np.broadcast_to(np.arange(cy.shape[1] + 1), (len(xs), cy.shape[1] + 1)).astype(np.int32)
        done = row[np.arange(len(xs)), ny].astype(float)
        for i in range(cx.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            for j in range(cy.shape[1]):
                new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (cx[:, i] != cy[:, j]))
            row = new
            done = np.where(nx == i + 1, row[np.arange(len(xs)), ny], done)
        out[lo:lo + STRING_PAIRS] = done
    return out


def _codes(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros((len(texts), 0), np.int32)
    return np.array([t.ljust(width, "\0") for t in texts], dtype=f"<U{width}").view(np.int32).reshape(len(texts), width)


def _column_gaps(a: pa.Array, b: pa.Array, kind: str, decimals: int | None):
    """A function of (rows of a, rows of b) that gives their matrix of distances."""
    def values(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        none = x.is_null().to_numpy(zero_copy_only=False)
        v = x.fill_null(0).to_numpy(zero_copy_only=False)
        return v, none | np.isnan(v) if kind == "abs" else none

    if kind == "edit":
        both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
        words = np.array(both.dictionary.to_pylist(), dtype=object)
        codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ca, cb = codes[:len(a)], codes[len(a):]
        ua, ub = np.unique(ca[ca >= 0]), np.unique(cb[cb >= 0])
        gaps = edit_distances(words[np.repeat(ua, len(ub))], words[np.tile(ub, len(ua))]) if len(ua) and len(ub) else np.zeros(0)
        table = np.full((len(ua) + 1, len(ub) + 1), INF)  # the last row and column are null
        table[:-1, :-1], table[-1, -1] = gaps.reshape(len(ua), len(ub)), 0.0
        pa_, pb_ = (np.where(c < 0, len(u), np.searchsorted(u, c)) for c, u in ((ca, ua), (cb, ub)))
        return lambda i: table[pa_[i][:, None], pb_[None, :]]
    (va, na), (vb, nb) = values(a), values(b)

    def gap(i: slice) -> np.ndarray:
        x, y = va[i, None], vb[None, :]
        if kind == "days":
            d = (np.abs(x - y) // MICROS_PER_DAY).astype(np.float64)
        else:
            with np.errstate(invalid="ignore"):
                d = np.abs(x - y)
            d[np.isnan(d)] = INF
            d[(x == y)] = 0.0
            if decimals is not None:
                d = np.rint(d * 10.0**decimals) / 10.0**decimals
        one, two = na[i, None], nb[None, :]
        d[one | two] = INF
        d[one & two] = 0.0
        return d

    return gap


def first_rows(m: np.ndarray) -> np.ndarray:
    """Places of rows that hold every distinct row of a matrix (rarely one twice)."""
    h = np.zeros(len(m), np.uint64)
    for d in range(m.shape[1]):
        h = (h ^ m[:, d].copy().view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    other = np.flatnonzero((m != m[first[inverse.ravel()]]).any(axis=1))  # equal hashes of different rows
    return np.concatenate([first, other])


def _packed(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * 8
    offsets = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m, "<f8"))])


def _cell(attrs: list[str], kinds: dict[str, str], decimals: dict[str, int | None], id_col: str | None):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role = t.column("_role").to_numpy()
        one, two = (t.filter(pa.array(role == r)).combine_chunks() for r in (0, 1))
        col = lambda x, c: x.column(c).combine_chunks() if x.num_rows else pa.array([], x.schema.field(c).type)
        out, ids = [np.zeros((0, len(attrs)))], []
        if one.num_rows and two.num_rows:
            gaps = [_column_gaps(col(one, f"_{i}"), col(two, f"_{i}"), kinds[c], decimals[c]) for i, c in enumerate(attrs)]
            na, nb = col(one, "_row").to_numpy(), col(two, "_row").to_numpy()
            apart = one.column("_p")[0].as_py() != one.column("_q")[0].as_py()
            step = max(1, PAIRS // two.num_rows)
            for lo in range(0, one.num_rows, step):
                i = slice(lo, min(lo + step, one.num_rows))
                m = np.stack([g(i) for g in gaps], axis=-1)
                use = np.ones(m.shape[:2], bool) if apart else na[i, None] < nb[None, :]
                if id_col is None:
                    m = m[use]
                    out.append(m[first_rows(m)])
                else:
                    x, y = np.nonzero(use)
                    out.append(m[x, y])
                    ids.append((col(one, "_id").take(pa.array(x + lo)), col(two, "_id").take(pa.array(y))))
        if id_col is None:
            m = np.concatenate(out)
            return pa.table({"vec": _packed(m[first_rows(m)] if len(m) else m)})
        kind = t.schema.field("_id").type
        ends = [pa.chunked_array([x[s] for x in ids], kind) for s in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1], "vec": _packed(np.concatenate(out))})

    return run


def packed_distances(df: DataFrame, attrs: list[str], kinds: dict[str, str], decimals: int = 6, id_col: str | None = None,
                     blocks: int | None = None) -> DataFrame:
    """``vec``: the distinct distance vectors of all pairs of rows, 8 bytes (little-endian double) per attribute.

    Metrics are ``abs``, ``days`` and ``edit``.  With ``id_col`` every pair of rows keeps its vector: ``a, b, vec``.
    """
    if bad := {k for k in kinds.values() if k not in ("abs", "days", "edit")}:
        raise ValueError(f"packed vectors know no metric {bad}")
    cols = [F.col(f"`{c}`") for c in attrs]
    shape = {"abs": lambda c: c.cast("double"), "days": micros, "edit": lambda c: c.cast("string")}
    values = [shape[kinds[c]](x).alias(f"_{i}") for i, (c, x) in enumerate(zip(attrs, cols))]
    if id_col is None:
        rows = df.groupBy(*cols).agg((F.count("*") > 1).alias("_copies")).select(*values, "_copies")
        ids = []
    else:
        rows = df.select(*values, F.col(f"`{id_col}`").alias("_id"))
        ids = ["_id"]
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "tuples")
    blocks = blocks or block_count(rows.count(), df.sparkSession.sparkContext.defaultParallelism)
    base = rows.select("_row", *ids, *[f"_{i}" for i in range(len(attrs))], F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_blk"))
    low = base.select("*", F.lit(0).alias("_role"), F.col("_blk").alias("_p"), F.explode(F.sequence("_blk", F.lit(blocks - 1))).alias("_q"))
    high = base.select("*", F.lit(1).alias("_role"), F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_p"), F.col("_blk").alias("_q"))
    both = low.unionByName(high).drop("_blk").repartition(max(1, min(blocks * (blocks + 1) // 2, 100_000)), "_p", "_q")
    round_to = {c: None if is_whole(df.schema[c].dataType, kinds[c]) else decimals for c in attrs}
    vec = T.StructField("vec", T.BinaryType())
    if id_col is not None:
        kind = df.schema[id_col].dataType
        out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), vec])
        return both.groupBy("_p", "_q").applyInArrow(_cell(attrs, kinds, round_to, id_col), out)
    vectors = both.groupBy("_p", "_q").applyInArrow(_cell(attrs, kinds, round_to, None), T.StructType([vec]))
    zero = rows.filter("_copies").limit(1).select(F.lit(bytearray(8 * len(attrs))).alias("vec"))
    return vectors.unionByName(zero).distinct()


def unpacked(packed: DataFrame, attrs: list[str]) -> DataFrame:
    """Packed vectors as one double column per attribute; other columns are kept."""
    others = [f for f in packed.schema.fields if f.name != "vec"]

    def run(batches):
        for b in batches:
            v = b.column("vec")
            m = np.frombuffer(v.buffers()[2] or b"", "<f8")[v.offset * len(attrs):(v.offset + len(v)) * len(attrs)].reshape(len(v), len(attrs))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], *[pa.array(m[:, i]) for i in range(len(attrs))]],
                                             names=[*[f.name for f in others], *attrs])

    return packed.mapInArrow(run, T.StructType([*others, *[T.StructField(c, T.DoubleType()) for c in attrs]]))
