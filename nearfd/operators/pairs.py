"""Pairwise attribute distances and what is derived from them."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import INF, Metric, choose_metrics, distance, is_whole
from ..plans.blocks import block_count, pair_blocks
from ..plans.prefix import exact_medians
from ..session import is_stored, materialize
from .coded import coded_distances
from .packed import packed_distances, unpacked
from .taxonomy import ancestor_maps, with_ancestors

Sides = list[tuple[str, list[str]]]
DICTIONARY = 64  # values of a string column that get a distance table
DICTIONARY_ROWS = 500  # tuples from which such a table pays off
WIDE = 12  # attributes from which vectors travel packed
COUNTED = 2_000_000  # vectors that are counted at a time
KEPT_VALUES = 4_000_000  # different values that a task keeps
WHOLE_HISTOGRAM = 250_000  # vectors whose values may be ranked in one task per attribute


def side_combinations(columns: list[str], rhs: str | None = None, lhs: list[str] | None = None) -> Sides:
    """Right/left side choices: none given means every column once as RHS."""
    if len(set(columns)) != len(columns):
        raise ValueError("repeated column")
    if rhs is None:
        if lhs:
            raise ValueError("a left side needs a right side")
        return [(c, [o for o in columns if o != c]) for c in columns]
    for c in [rhs, *(lhs or [])]:
        if c not in columns:
            raise ValueError(f"unknown column {c!r}")
    left = list(lhs) if lhs else [o for o in columns if o != rhs]
    if rhs in left or len(set(left)) != len(left):
        raise ValueError("a column may be used once")
    return [(rhs, left)]


def _col(side: str, name: str) -> Column:
    return F.col(side).getField(name)


def _edit_tables(rows: DataFrame, names: list[str]) -> dict[str, tuple[list[str], Column]]:
    """Edit distances between all values of the string columns with few values.

    Gives each such column its values and a metric on their positions, so that a
    pair looks its distance up instead of computing it again.
    """
    few = rows.agg(*[F.approx_count_distinct(F.col(f"`{c}`")) for c in names]).first()
    tables = {}
    for i, c in enumerate(names):
        if few[i] > DICTIONARY:
            continue
        values = [r[0] for r in rows.select(F.col(f"`{c}`")).dropna().distinct().limit(DICTIONARY + 1).collect()]
        n = len(values)
        if not 0 < n <= DICTIONARY:
            continue
        at = rows.sparkSession.range(n * n).select("id", F.array(*map(F.lit, values)).alias("v"))
        gaps = at.select("id", F.levenshtein(F.expr(f"element_at(v, cast(id div {n} as int) + 1)"),
                                             F.expr(f"element_at(v, cast(id % {n} as int) + 1)")).alias("d"))
        text = ",".join(str(r["d"]) for r in gaps.orderBy("id").collect())
        tables[c] = (values, F.split(F.lit(text), ",").cast("array<double>"))
    return tables


def pair_distances(
    df: DataFrame,
    attrs: list[str] | None = None,
    id_col: str | None = None,
    metrics: Mapping[str, Metric] | None = None,
    ordered: bool = False,
    decimals: int = 6,
    blocks: int | None = None,
    distinct: bool = True,
    lexicon: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Distance of every unordered pair of rows on every attribute.

    By default the distinct distance vectors.  Those depend only on the distinct
    attribute tuples, so copies are folded before rows are paired: the cost is
    quadratic in distinct tuples, not in rows.  ``distinct=False`` keeps one row
    per pair with ``<id>_a < <id>_b``; ``ordered=True`` gives all n*n pairs with
    the diagonal.  Both of these need ``id_col``.  Tables of more than ``WIDE``
    attributes go through packed vectors, unless a metric is a function or the
    taxonomy.
    """
    attrs = list(attrs) if attrs else [c for c in df.columns if c != id_col]
    kinds = choose_metrics(df, attrs, metrics, lexicon)
    by_row = ordered or not distinct
    if by_row and id_col is None:
        raise ValueError("pairs of rows need id_col")
    spark = df.sparkSession
    cols = [F.col(f"`{c}`") for c in attrs]
    if len(attrs) > WIDE and all(k in ("abs", "days", "edit") for k in kinds.values()):
        vectors = packed_distances(df, attrs, kinds, decimals, id_col if by_row else None, blocks)
        if not by_row:
            return unpacked(vectors, attrs)
        x, y = F.col("a"), F.col("b")
        vectors = vectors.select(F.least(x, y).alias(f"{id_col}_a"), F.greatest(x, y).alias(f"{id_col}_b"), "vec")
        result = unpacked(vectors, attrs)
        return _both_ways(result, df, id_col, attrs) if ordered else result
    if by_row:
        rows = df.select(F.col(f"`{id_col}`"), *cols)
    else:
        rows = df.select(*cols).groupBy(*cols).agg((F.count("*") > 1).alias("_copies"))
    if blocks is None or not by_row:
        rows = materialize(rows, "tuples")
    if not by_row and all(isinstance(k, str) for k in kinds.values()):
        coded = coded_distances(df, attrs, kinds, decimals, blocks, rows)
        if coded is not None:
            return coded
    if blocks is None:
        blocks = block_count(rows.count(), spark.sparkContext.defaultParallelism)
    copies = None if by_row else rows.filter("_copies").limit(1)
    rows = rows if by_row else rows.drop("_copies")

    key = F.col(f"`{id_col}`") if by_row else F.struct(*cols)
    # the key travels as a struct beside the values, so a term may become a map
    base = rows.withColumn("_key", key)
    if "taxonomy" in kinds.values():
        if lexicon is None or taxonomy is None:
            raise ValueError("the taxonomy metric needs lexicon and taxonomy")
        maps = materialize(ancestor_maps(lexicon, taxonomy), "terms")
        for c in attrs:
            if kinds[c] == "taxonomy":
                base = with_ancestors(base, c, maps)
    strings = [c for c in attrs if kinds[c] == "edit"]
    if strings and not by_row and rows.count() >= DICTIONARY_ROWS:
        for c, (values, gaps) in _edit_tables(rows, strings).items():
            place = F.array_position(F.array(*map(F.lit, values)), F.col(f"`{c}`")).cast("int") - 1
            base = base.withColumn(c, place)
            kinds[c] = lambda a, b, gaps=gaps, n=len(values): F.element_at(gaps, a * n + b + 1)
    whole = {c: is_whole(df.schema[c].dataType, kind) for c, kind in kinds.items()} | {c: True for c in strings}
    pairs = pair_blocks(base, F.col("_key"), F.col("_key"), blocks)
    gaps = [
        distance(_col("a", c), _col("b", c), kinds[c],
                 None if whole[c] else decimals).alias(c)
        for c in attrs
    ]
    zero = [F.lit(0.0).alias(c) for c in attrs]
    if not by_row:
        vectors = pairs.select(*gaps)
        return vectors.unionByName(copies.select(*zero)).distinct()
    x, y = _col("a", id_col), _col("b", id_col)
    ids = [F.least(x, y).alias(f"{id_col}_a"), F.greatest(x, y).alias(f"{id_col}_b")]
    result = pairs.select(*ids, *gaps)
    return _both_ways(result, rows, id_col, attrs) if ordered else result


def _both_ways(result: DataFrame, rows: DataFrame, id_col: str, attrs: list[str]) -> DataFrame:
    """Each pair in both directions, and the diagonal."""
    a, b = f"{id_col}_a", f"{id_col}_b"
    # one pass gives both directions of a pair
    both = result.select(F.explode(F.array(
        F.struct(F.col(a).alias("x"), F.col(b).alias("y")),
        F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("p"), *[F.col(f"`{c}`") for c in attrs])
    both = both.select(F.col("p.x").alias(a), F.col("p.y").alias(b), *[F.col(f"`{c}`") for c in attrs])
    diagonal = rows.select(F.col(f"`{id_col}`").alias(a), F.col(f"`{id_col}`").alias(b), *[F.lit(0.0).alias(c) for c in attrs])
    return both.unionByName(diagonal)


def split_sides(pairs: DataFrame, rhs: str, lhs: list[str] | None = None) -> DataFrame:
    """The right side first, renamed ``RHS``, then the left side columns."""
    (right, left), = side_combinations(pairs.columns, rhs, lhs)
    return pairs.select(F.col(f"`{right}`").alias("RHS"), *[F.col(f"`{c}`") for c in left])


def _value_counts(pairs: DataFrame, attrs: list[str]) -> DataFrame:
    """``(attr, part, value, cnt)``: how often each distance occurs, counted in the tasks first."""
    def run(batches):
        kept, waiting, size = [(np.empty(0), np.empty(0, np.int64)) for _ in attrs], [], 0

        def counted():
            for i, (values, counts) in enumerate(kept):
                v, n = np.unique(np.concatenate([w[i] for w in waiting]), return_counts=True)
                if len(values):
                    v, place = np.unique(np.concatenate([values, v]), return_inverse=True)
                    n = np.bincount(place.ravel(), np.concatenate([counts, n])).astype(np.int64)
                kept[i] = (v, n)
            waiting.clear()

        def rows():
            for i, c in enumerate(attrs):
                v, n = kept[i]
                kept[i] = (v[:0], n[:0])
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.string()), pa.array(v), pa.array(n)], names=["attr", "value", "cnt"])

        for b in batches:
            waiting.append([b.column(c).to_numpy(zero_copy_only=False) for c in attrs])
            size += b.num_rows
            if size >= COUNTED:
                counted()
                size = 0
                if sum(len(v) for v, _ in kept) > KEPT_VALUES:
                    yield from rows()
        if waiting:
            counted()
        yield from rows()

    counts = pairs.select(*[F.col(f"`{c}`") for c in attrs]).mapInArrow(run, "attr string, value double, cnt long")
    return counts.groupBy("attr", "value").agg(F.sum("cnt").alias("cnt")).select("attr", F.lit(0).alias("part"), "value", "cnt")


def distance_medians(pairs: DataFrame, attrs: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``(attr, median)`` of each distance column, exact unless ``approx``.

    The exact form of a large table reads ``pairs`` twice and shuffles little: a
    mergeable sketch brackets the median (its rank error is a tenth of the
    bracket's margin), then only the values inside the bracket are ranked.
    Vectors that are whole numbers are counted by value in one pass.
    """
    attrs = list(attrs) if attrs else list(pairs.columns)
    if is_stored(pairs) and not approx:
        return exact_medians(materialize(_value_counts(pairs, attrs), "hist"))
    if approx or pairs.count() > WHOLE_HISTOGRAM:
        ends = [0.5] if approx else [0.498, 0.502]
        marks = pairs.agg(*[
            F.percentile_approx(F.col(f"`{c}`"), F.array(*map(F.lit, ends)), F.lit(5_000)).alias(f"m{i}")
            for i, c in enumerate(attrs)]).first()
    else:
        marks = [(-INF, INF)] * len(attrs)
    if approx:
        rows = [(c, marks[i][0] if marks[i] else None) for i, c in enumerate(attrs)]
        return pairs.sparkSession.createDataFrame(rows, "attr string, median double")
    pieces = []
    for i, c in enumerate(attrs):
        lo, hi = marks[i] or (0.0, 0.0)
        v = F.col(f"`{c}`")
        place = F.when(v < lo, F.lit(-INF)).when(v > hi, F.lit(INF)).otherwise(v)
        pieces.append(F.struct(F.lit(c).alias("attr"), place.alias("value"),
                               F.when(v < lo, -1).when(v > hi, 1).otherwise(0).alias("part")))
    hist = (pairs.select(F.explode(F.array(*pieces)).alias("m"))
            .groupBy("m.attr", "m.part", "m.value").agg(F.count("*").alias("cnt")))
    if marks[0] and marks[0][0] == -INF:
        return exact_medians(hist, small=True)
    return exact_medians(materialize(hist, "hist"))


def median_sketches(pairs: DataFrame, part: str, attrs: list[str] | None = None, k: int = 1000) -> DataFrame:
    """``(part, attr, n, sketch)``: a mergeable quantile sketch of every distance column, to be stored beside the table.

    ``part`` names the part of the table whose pairs these are.  When rows are appended, the pairs they form are
    sketched as a part of their own; no old pair is read again.
    """
    attrs = list(attrs) if attrs else list(pairs.columns)
    made = pairs.agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), F.lit(k)).alias(f"s{i}") for i, c in enumerate(attrs)])
    rows = [F.struct(F.lit(part).alias("part"), F.lit(c).alias("attr"), F.col("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(attrs)]
    return made.filter("n > 0").select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sketched_medians(sketches: DataFrame, k: int = 1000) -> DataFrame:
    """``(attr, n, median)`` from the sketches of all parts: a value whose rank is within ``sketch_error(k)`` of the
    middle with a confidence of 99 %.  A vector that several parts have counts in each of them."""
    merged = sketches.groupBy("attr").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    return merged.select("attr", "n", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median"))


def sketch_error(k: int = 1000) -> float:
    """Largest share of ranks by which a median of sketches of size ``k`` is off (Karnin, Lang and Liberty, FOCS 2016;
    the constant is that of the sketch library's double-sided bound)."""
    return 2.446 / k**0.9433
