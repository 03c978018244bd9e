"""Distinct pair distances as whole numbers.

Numbers on a decimal grid, days and edit distances are whole numbers of a known range, so a distance vector is one
number in mixed radix.  Rows are sorted by the attribute with most values and cut into blocks; two blocks form a cell.
Cells whose blocks are equally far apart have differences of the same narrow range, so a group of them marks what it
finds in one bitmap, and copies of a vector leave it once.  What leaves a cell are sorted numbers, dealt by remainder to
buckets and packed as gaps; a bucket drops the copies that several groups found and hands on plain columns.  Edit
distances of a cell are filled over the tries of its two blocks, so common prefixes are compared once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import INF, MICROS_PER_DAY, is_whole, micros
from ..plans.blocks import block_count
from ..session import Later, mark_stored, materialize

DENSE_ROWS = 4096  # rows of a block whose vectors fit a bitmap
SPARSE_ROWS = 2048
SLOTS = 1 << 26  # numbers of one bitmap
GROUP_CELLS = 8
SLICE_PAIRS = 1 << 19
WORDS = 512  # strings of one side whose edit distances are filled at a time
BUCKET = 1 << 22  # vectors of a bucket
RUN = 1 << 16  # vectors of a written row
GRID = 2.0**44  # largest number on a decimal grid, in its last place


@dataclass(frozen=True)
class Axis:
    """The distances of one attribute: ``size - 1`` whole numbers, the last one stands for infinity."""

    kind: str
    size: int
    scale: int = 1  # steps of a value in one
    unit: float | None = None  # 10**decimals if distances are rounded


@dataclass(frozen=True)
class Rows:
    """What the vectors are made of: the distinct tuples as columns ``_0..`` and how they are coded; ``zero``: some had copies."""

    values: DataFrame
    attrs: list[str]
    space: list[Axis]
    by: int | None
    n: int
    zero: bool


def _value(c, kind):
    return {"abs": lambda: c.cast("double"), "days": lambda: micros(c), "edit": lambda: c.cast("string")}[kind]()


def axes(rows: DataFrame, kinds: list[str], round_to: list[int | None]) -> tuple[list[Axis], int | None] | None:
    """The axis of every column ``_0..`` and the place of the numeric one with most values; None if a number is off the grid."""
    found = []
    for i, (kind, decimals) in enumerate(zip(kinds, round_to, strict=True)):
        c = F.col(f"_{i}")
        if kind == "edit":
            found.append(F.struct(F.max(F.length(c)).cast("double").alias("hi")))
            continue
        known = F.when(~F.isnan(c) & (F.abs(c) < INF), c) if kind == "abs" else c
        off = []
        if decimals is not None:
            # off the grid of d places, in steps of the last place that rounding keeps
            off = [F.max(F.abs(known * 10.0**decimals - F.rint(known * 10.0**d) * 10.0**(decimals - d))) for d in range(decimals + 1)]
        found.append(F.struct(F.max(known).alias("hi"), F.min(known).alias("lo"), F.approx_count_distinct(known).alias("n"),
                              F.array(*off, F.lit(0.0)).alias("off")))
    stats = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(found)]).first()
    out, best = [], None
    for i, (kind, decimals) in enumerate(zip(kinds, round_to, strict=True)):
        s = stats[i]
        if kind == "edit":
            out.append(Axis("edit", int(s["hi"] or 0) + 2))
            continue
        if s["hi"] is None:
            out.append(Axis(kind, 2))
            continue
        if best is None or s["n"] > best[0]:
            best = (s["n"], i)
        if kind == "days":
            out.append(Axis("days", int((s["hi"] - s["lo"]) // MICROS_PER_DAY) + 2))
            continue
        top = max(abs(s["hi"]), abs(s["lo"]))
        if decimals is None:
            if top > 2.0**51:
                return None
            out.append(Axis("abs", int(s["hi"] - s["lo"]) + 2))
            continue
        places = next((d for d in range(decimals + 1) if s["off"][d] <= 0.125), None)
        if places is None or top * 10.0**decimals > GRID:
            return None
        scale = 10**places
        out.append(Axis("abs", int(np.rint(s["hi"] * scale) - np.rint(s["lo"] * scale)) + 2, scale, 10.0**decimals))
    if math.prod(a.size for a in out) >= 1 << 62:
        return None
    return out, None if best is None else best[1]


# ----------------------------------------------------------- edit distances

def _trie(words: list[str], plain: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Per depth ``(parent, char, node of word)`` of sorted different words, and their lengths."""
    size = np.array([len(w) for w in words])
    width = int(size.max(initial=0))
    codes = np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{max(1, width)}").view(np.uint32).reshape(len(words), -1)[:, :width]
    same = np.zeros((len(words), width), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (np.arange(width) < np.minimum(size[1:], size[:-1])[:, None])
    common = np.minimum.accumulate(same, axis=1).sum(axis=1)
    narrow = np.uint8 if plain else np.uint32
    levels, before = [], np.zeros(len(words), np.int64)
    for d in range(1, width + 1):
        new = (size >= d) & (common < d)
        node, first = np.cumsum(new) - 1, np.flatnonzero(new)
        levels.append((before[first], codes[first, d - 1].astype(narrow), node))
        before = node
    return levels, size


def edit_table(one: list[str], two: list[str]) -> np.ndarray:
    """Edit distances of all pairs of two lists of sorted different strings."""
    every = [*one, *two]
    out = np.zeros((len(one), len(two)), np.uint8 if max(map(len, every), default=0) < 250 else np.uint16)
    if not len(one) or not len(two):
        return out
    low, high = min(every), max(every)
    lead = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    plain = all(map(str.isascii, every))
    two_levels, two_size = _trie([w[lead:] for w in two], plain)
    kind, step = out.dtype, out.dtype.type(1)
    for lo in range(0, len(one), WORDS):
        levels, size = _trie([w[lead:] for w in one[lo:lo + WORDS]], plain)
        row = [np.zeros((1, 1), kind)]
        row += [np.full((1, len(chars)), d + 1, kind) for d, (_, chars, _) in enumerate(two_levels)]
        for d in range(len(levels) + 1):
            if d:
                parent, char, _ = levels[d - 1]
                new = [np.full((len(char), 1), d, kind)]
                for e, (back, other, _) in enumerate(two_levels):
                    best = row[e].take(back, axis=1).take(parent, axis=0)
                    best += char[:, None] != other[None, :]
                    gap = row[e + 1].take(parent, axis=0)
                    np.minimum(gap, new[e].take(back, axis=1), out=gap)
                    gap += step
                    new.append(np.minimum(best, gap, out=best))
                row = new
            ends = np.flatnonzero(size == d)
            if not len(ends):
                continue
            node = levels[d - 1][2][ends] if d else np.zeros(len(ends), np.int64)
            for e in np.unique(two_size):
                stop = np.flatnonzero(two_size == e)
                at = two_levels[e - 1][2][stop] if e else np.zeros(len(stop), np.int64)
                out[np.ix_(ends + lo, stop)] = row[e].take(node, axis=0).take(at, axis=1)
    return out


# -------------------------------------------------------------------- cells

class _Numbers:
    """A numeric column of a group: whole values and what is no number (1 null or NaN, 2 and 3 the infinities)."""

    def __init__(self, column: pa.Array, axis: Axis):
        v = column.fill_null(0).to_numpy(zero_copy_only=False)
        self.odd = column.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
        if axis.kind == "abs":
            self.odd[np.isnan(v)] = 1
            self.odd[v == INF] = 2
            self.odd[v == -INF] = 3
            v = np.rint(np.where(self.odd == 0, v, 0.0) * axis.scale)
        v = v.astype(np.int64)
        sure = v[self.odd == 0]
        v -= sure.min() if len(sure) else 0
        self.step = MICROS_PER_DAY if axis.kind == "days" else 1
        self.value = v.astype(np.int32) if self.step == 1 and v.max(initial=0) < 1 << 30 else v

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        """Smallest and largest distance the rows of two blocks can have."""
        x, y = self.value[a][self.odd[a] == 0], self.value[b][self.odd[b] == 0]
        low = 0 if self.odd[a].any() or self.odd[b].any() else INF
        if not len(x) or not len(y):
            return 0, 0
        x0, x1, y0, y1 = (int(f()) // 1 for f in (x.min, x.max, y.min, y.max))
        return min(low, max(0, x0 - y1, y0 - x1) // self.step), max(x1 - y0, y1 - x0, 0) // self.step

    def gaps(self, a: np.ndarray, b: np.ndarray, low: int, none: int) -> np.ndarray:
        d = np.abs(self.value[a][:, None] - self.value[b][None, :])
        if self.step != 1:
            d //= self.step
        if low:
            d -= low
        x, y = self.odd[a][:, None], self.odd[b][None, :]
        if x.any() or y.any():
            d = np.where((x != 0) | (y != 0), np.where(x == y, 0, none), d)
        return d


class _Strings:
    """A string column of a group."""

    def __init__(self, column: pa.Array, axis: Axis):
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]
        rank = np.empty(len(words) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(words)), -1  # a null is at place -1
        self.code = rank[coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)]
        self.top = axis.size - 2

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        return 0, self.top

    def open(self, a: np.ndarray, b: np.ndarray) -> None:
        """Fill the distances of one cell."""
        (ua, self.a), (ub, self.b) = (np.unique(self.code[x], return_inverse=True) for x in (a, b))
        words = [[self.words[i] for i in u if i >= 0] for u in (ua, ub)]
        gaps = edit_table(*words)
        na, nb = int(ua[0] < 0), int(ub[0] < 0)
        if na or nb:
            whole = np.full((len(ua), len(ub)), self.top + 1, np.uint32)
            whole[na:, nb:] = gaps
            if na and nb:
                whole[0, 0] = 0
            gaps = whole
        self.table = gaps

    def gaps(self, i: slice) -> np.ndarray:
        return self.table.take(self.a[i], axis=0).take(self.b, axis=1)


def _packed(codes: np.ndarray, buckets: int) -> pa.Table:
    """Sorted different codes as one row of gaps per bucket."""
    rest, bucket = np.divmod(codes, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    rest, bucket = rest[order], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
    blobs = []
    for lo, hi in zip(starts, [*starts[1:], len(rest)], strict=True):
        gaps = np.diff(rest[lo:hi], prepend=0)
        top = int(gaps[1:].max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
        blobs.append(int(gaps[0]).to_bytes(8, "little") + bytes([width]) + gaps[1:].astype(f"<u{width}").tobytes())
    return pa.table({"bucket": pa.array(bucket[starts].astype(np.int32)), "codes": pa.array(blobs, pa.binary())})


def unpack(blob: bytes) -> np.ndarray:
    """The numbers of one bucket row."""
    width = blob[8]
    gaps = np.frombuffer(blob, f"<u{width}", offset=9).astype(np.int64)
    return np.cumsum(np.append(np.frombuffer(blob, "<i8", 1), gaps))


def group_codes(t: pa.Table, space: list[Axis], buckets: int) -> pa.Table:
    """The vectors of all cells of a group; cells have the rows of one block in role 0 and of one in role 1."""
    t = t.combine_chunks()
    role, place, at = (t.column(c).to_numpy() for c in ("_role", "_p", "_at"))
    column = lambda i: t.column(f"_{i}").combine_chunks()
    data = [(_Strings if x.kind == "edit" else _Numbers)(column(i), x) for i, x in enumerate(space)]
    cells = []
    for p in np.unique(place):
        a, b = (np.flatnonzero((place == p) & (role == r)) for r in (0, 1))
        if len(a) and len(b):
            a, b = a[np.argsort(at[a])], b[np.argsort(at[b])]
            if at[a[0]] != at[b[0]] or len(a) > 1:  # a block of one row has no pair with itself
                cells.append((a, b))
    if not cells:
        return _packed(np.empty(0, np.int64), buckets)
    spans = np.array([[d.span(a, b) for d in data] for a, b in cells], np.int64)
    low, high = spans[:, :, 0].min(axis=0), spans[:, :, 1].max(axis=0)
    sizes = [int(h - l) + 2 for l, h in zip(low, high, strict=True)]  # noqa: E741
    total = math.prod(sizes)
    seen = np.zeros(total, bool) if total <= SLOTS else None
    found = []

    def coded(slots: np.ndarray) -> np.ndarray:
        """Numbers in the group's ranges as numbers in the whole ranges, sorted."""
        code, left = np.zeros(len(slots), np.int64), slots
        parts = []
        for l, s in zip(reversed(low), reversed(sizes), strict=True):  # noqa: E741
            left, v = np.divmod(left, s)
            parts.append((v, int(l), s))
        for (v, l, s), axis in zip(reversed(parts), space, strict=True):  # noqa: E741
            code = code * axis.size + np.where(v == s - 1, axis.size - 1, v + l)
        return code

    for a, b in cells:
        for d in data:
            if isinstance(d, _Strings):
                d.open(a, b)
        step, mine, own = max(1, SLICE_PAIRS // len(b)), [], at[a[0]] == at[b[0]]
        for lo in range(0, len(a), step):
            i = slice(lo, min(lo + step, len(a)))
            slots = np.zeros((i.stop - lo, len(b)), np.int64)
            for d, l, s in zip(data, low, sizes, strict=True):  # noqa: E741
                if s > 1:
                    slots *= s
                    slots += d.gaps(i) if isinstance(d, _Strings) else d.gaps(a[i], b, int(l), s - 1)
            if own:  # a row makes no pair with itself: repeat another pair of it
                n = np.arange(lo, i.stop)
                slots[n - lo, n] = slots[n - lo, (n + 1) % len(b)]
            if seen is not None:
                seen[slots.ravel()] = True
            else:
                mine.append(slots.ravel())
        if mine:
            found.append(_packed(np.sort(coded(_distinct(np.concatenate(mine)))), buckets))
    return pa.concat_tables(found) if seen is None else _packed(np.sort(coded(np.flatnonzero(seen))), buckets)


def _distinct(v: np.ndarray) -> np.ndarray:
    v.sort()
    return v[np.append(True, v[1:] != v[:-1])] if len(v) else v


def bucket_codes(t: pa.Table, buckets: int) -> np.ndarray:
    """The different vectors of a bucket."""
    t = t.combine_chunks()
    if not t.num_rows:
        return np.empty(0, np.int64)
    rest = _distinct(np.concatenate([unpack(b) for b in t.column("codes").to_pylist()]))
    return rest * buckets + t.column("bucket")[0].as_py()


def columns_of(codes: np.ndarray, space: list[Axis]) -> list[np.ndarray]:
    """The distances of every attribute."""
    out = []
    for axis in reversed(space):
        codes, v = np.divmod(codes, axis.size)
        far = v == axis.size - 1
        d = v.astype(np.float64)
        if axis.unit is not None:
            d = d * (axis.unit / axis.scale) / axis.unit
        d[far] = INF
        out.append(d)
    return out[::-1]


def coded_distances(df: DataFrame, attrs: list[str], kinds: dict[str, str], decimals: int = 6, blocks: int | None = None,
                    rows: DataFrame | None = None) -> DataFrame | None:
    """The distinct distance vectors of all pairs of rows, one double column per attribute; None if a number is off the grid.

    ``rows`` are the distinct tuples with ``_copies`` (written), ``kinds`` are ``abs``, ``days`` and ``edit``.
    The vectors are written when they are first read; what discovery needs of them it can make from the frame's ``source``.
    """
    if not 0 <= decimals <= 9 or any(k not in ("abs", "days", "edit") for k in kinds.values()):
        return None
    spark = df.sparkSession
    cols = [F.col(f"`{c}`") for c in attrs]
    values = rows.select(*[_value(x, kinds[c]).alias(f"_{i}") for i, (c, x) in enumerate(zip(attrs, cols, strict=True))])
    n = rows.count()
    made = axes(values, [kinds[c] for c in attrs], [None if is_whole(df.schema[c].dataType, kinds[c]) else decimals for c in attrs])
    if made is None:
        return None
    space, by = made
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in attrs])
    out = Later(spark, schema, lambda: _written(values, rows, attrs, space, by, n, blocks))
    out.source = lambda: Rows(values, attrs, space, by, n, not rows.filter("_copies").isEmpty())
    return mark_stored(out)


def _written(values: DataFrame, rows: DataFrame, attrs: list[str], space: list[Axis], by: int | None, n: int, blocks: int | None) -> DataFrame:
    """The vectors as packed gaps on disk, opened to columns."""
    spark = values.sparkSession
    total = math.prod(a.size for a in space)
    cores = spark.sparkContext.defaultParallelism
    dense = blocks or block_count(n, cores, DENSE_ROWS)
    narrow = total if by is None else 2 * total // dense
    blocks = dense if narrow <= SLOTS else blocks or block_count(n, cores, SPARSE_ROWS)
    cells = blocks * (blocks + 1) // 2
    a_group = max(1, min(GROUP_CELLS, cells // (4 * cores))) if narrow <= SLOTS else 1
    size = max(1, math.ceil(n / blocks))
    buckets = max(1, min(4 * cores, math.ceil(n * n / 2**17)), math.ceil(min(total, n * n // 2) / BUCKET)) | 1

    hashed = F.xxhash64(*[F.col(f"_{i}") for i in range(len(attrs))])
    order = [hashed] if by is None else [F.col(f"_{by}"), hashed]
    parts = max(1, min(blocks, 2 * cores))
    ordered = materialize(values.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # one number per partition of the sort
    counts = {r["part"]: r["n"] for r in ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0, *[counts.get(i, 0) for i in range(max(counts, default=0) + 1)]]).tolist()
    start = F.element_at(F.array(*map(F.lit, before)), (F.shiftright("_at", 33) + 1).cast("int"))
    base = (ordered.withColumn("_at", start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .withColumn("_blk", F.floor(F.col("_at") / size).cast("int")))
    last = F.lit(blocks - 1)
    first = base.select("*", F.lit(0).alias("_role"), F.explode(F.sequence(F.lit(0), last - F.col("_blk"))).alias("_k")).withColumn("_p", F.col("_blk"))
    second = base.select("*", F.lit(1).alias("_role"), F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_k")).withColumn("_p", F.col("_blk") - F.col("_k"))
    both = first.unionByName(second).withColumn("_g", F.floor(F.col("_p") / a_group).cast("int")).drop("_blk")
    both = both.repartition(max(1, min(math.ceil(cells / a_group), 10_000)), "_k", "_g")
    kind = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("codes", T.BinaryType())])
    found = both.groupBy("_k", "_g").applyInArrow(lambda t: group_codes(t, space, buckets), kind)
    zero = rows.filter("_copies").limit(1).select(F.lit(0).alias("bucket"), F.lit(bytearray(8) + bytearray([1])).alias("codes"))


    def merged(t: pa.Table) -> pa.Table:
        codes = bucket_codes(t, buckets)
        return pa.concat_tables([_packed(codes[lo:lo + RUN], buckets) for lo in range(0, len(codes), RUN)] or [_packed(codes, buckets)])

    vectors = materialize(found.unionByName(zero).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merged, kind), "vectors")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in attrs])

    def opened(batches):
        for b in batches:
            for bucket, codes in zip(b.column("bucket").to_pylist(), b.column("codes").to_pylist(), strict=True):
                columns = columns_of(unpack(codes) * buckets + bucket, space)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=attrs)

    return vectors.mapInArrow(opened, schema)
