"""Query relaxation: from the answers of an extended query to similar rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import INF, MICROS_PER_DAY, Metric, choose_metrics, micros, within
from ..session import materialize
from .query import QuerySpec, extend_query
from .rfd import Rfd, first_rfds
from .simjoin import MAX_BANDS, Side, _band, similarity_join


Metrics = Mapping[str, Metric | DataFrame]
NO_BAND = -(1 << 62)  # stands for the band of null in keys


def relaxing_attributes(df: DataFrame, rfd: Rfd, query: QuerySpec | None = None) -> list[str]:
    """Attributes of the dependency that the query leaves open, else its right side."""
    asked = set(query.fields) if query else set()
    return [c for c in df.columns if c in rfd and c not in asked] or [rfd.rhs]


def _number(c: Column) -> Column:
    """Value as a double; NaN is null."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _whole(c: Column, t: float) -> tuple[Column, Column]:
    """Whole-number bounds of a value, cut toward zero."""
    lo = F.when(c - t >= 0, F.floor(c - t)).otherwise(F.ceil(c - t))
    hi = F.when(c + t + 1 >= 0, F.floor(c + t + 1)).otherwise(F.ceil(c + t + 1)) - 1
    return lo.cast("double"), hi.cast("double")


def relax_rows(df: DataFrame, answers: DataFrame, rfd: Rfd, attrs: list[str] | None = None,
               query: QuerySpec | None = None, mode: str = "distance",
               metrics: Metrics | None = None) -> DataFrame:
    """Rows that are similar on every relaxing attribute to one answer row.

    ``mode='distance'`` uses the dependency's thresholds as they are;
    ``'integers'`` lets a numeric attribute match only the whole numbers between
    the cut bounds ``v - t`` and ``v + t``.  In both modes null matches null.  ``metrics`` are those the dependency
    was found with; a taxonomy is given as its table of similar values.
    """
    attrs = attrs or relaxing_attributes(df, rfd, query)
    kinds = choose_metrics(df, attrs, metrics)
    near = answers.select(*[F.col(f"`{c}`") for c in attrs]).distinct()
    if mode == "distance":
        return similarity_join(df, near, {c: (kinds[c], rfd[c]) for c in attrs}, "left_semi")
    if mode != "integers":
        raise ValueError("mode is 'distance' or 'integers'")
    # the band join stays the same with one unit of slack; the bounds decide
    data, marks, on = df, near, {}
    bounds = [c for c in attrs if kinds[c] == "abs" and rfd[c] > 0]
    for c in attrs:
        on[c] = (kinds[c], rfd[c] + 1 if c in bounds else rfd[c])
    for c in bounds:
        x = _number(F.col(f"`{c}`"))
        lo, hi = _whole(x, rfd[c])
        data = data.filter(x.isNull() | (x == F.floor(x)))
        marks = marks.withColumn(f"_lo_{c}", lo).withColumn(f"_hi_{c}", hi)

    def inside(l: Side, r: Side) -> Column:
        cond = F.lit(True)
        for c in bounds:
            x, lo = _number(l(c)), r(f"_lo_{c}")
            cond = cond & ((x.isNull() & lo.isNull()) | x.between(lo, r(f"_hi_{c}")))
        return cond

    return similarity_join(data, marks, on, "left_semi", extra=inside)


def _near_some(df: DataFrame, answers: DataFrame, c: str, kind: Metric | DataFrame, t: float, mode: str) -> DataFrame:
    """Rows whose value of one attribute is near some answer value.

    A number or date needs no pairs: per band only the smallest and the largest
    answer value can decide, so the answers shrink to one row per band.
    """
    col = F.col(f"`{c}`")
    values = answers.select(col.alias("_v")).distinct()
    if t == INF:
        return df
    if isinstance(kind, DataFrame):
        return similarity_join(df, values.withColumnRenamed("_v", c), {c: (kind, t)}, "left_semi")
    if kind == "abs" and t > 0 and mode == "integers":
        v = _number(F.col("_v"))
        lo, hi = _whole(v, t)
        # every reachable whole number, once, and null if an answer has it
        whole = F.when(v.isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(lo.cast("bigint"), hi.cast("bigint")))
        hits = values.select(F.explode(whole).alias("_n")).distinct()
        return df.join(hits, _number(col).eqNullSafe(F.col("_n").cast("double")), "left_semi")
    if kind == "days" or (kind == "abs" and t > 0):
        if kind == "days":
            x, width = micros(col), (int(t) + 1) * MICROS_PER_DAY
            v = micros(F.col("_v"))
        else:
            x, width = col.cast("double"), float(t)
            v = F.col("_v").cast("double")
        ends = (values.select(v.alias("_v"), F.floor(v / F.lit(width)).alias("_band")).groupBy("_band")
                .agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")))
        # the band itself and its neighbours; two spare bands absorb rounding
        reach = F.when(F.col("_band").isNull(), F.array(F.col("_band"))).otherwise(
            F.sequence(F.col("_band") - 2, F.col("_band") + 2))
        ends = (ends.select(F.explode(reach).alias("_reach"), "_band", "_min", "_max"))
        ends = ends.groupBy("_reach").agg(
            F.collect_list(F.struct("_band", "_min", "_max")).alias("_ends"))
        gap = (lambda a, b: F.abs(a - b)) if kind == "days" else (
            lambda a, b: F.rint(F.abs(a - b) * 1e6) / 1e6)
        limit = (lambda d: d < F.lit(width)) if kind == "days" else (lambda d: d <= F.lit(width))

        def hit(e: Column) -> Column:
            lo, hi = e.getField("_min"), e.getField("_max")
            inside = (x >= lo) & (x <= hi) & (e.getField("_band") == F.floor(x / F.lit(width)))
            return inside | limit(gap(x, lo)) | limit(gap(x, hi))

        cond = F.floor(x / F.lit(width)).eqNullSafe(F.col("_reach")) & (
            x.isNull() | F.exists("_ends", hit))
        return df.join(ends, cond, "left_semi")
    near = values.withColumnRenamed("_v", c)
    if kind == "edit" and t >= 1:
        # similar values first, then rows by equality
        like = similarity_join(df.select(col).distinct(), near, {c: (kind, t)}, "left_semi")
        return df.join(like.withColumnRenamed(c, "_v"), col.eqNullSafe(F.col("_v")), "left_semi")
    return similarity_join(df, near, {c: (kind, t)}, "left_semi")


def relax_columns(df: DataFrame, answers: DataFrame, rfd: Rfd, attrs: list[str] | None = None,
                  query: QuerySpec | None = None, mode: str = "distance",
                  metrics: Metrics | None = None) -> DataFrame:
    """Rows near some answer value on each relaxing attribute, taken one by one."""
    if mode not in ("distance", "integers"):
        raise ValueError("mode is 'distance' or 'integers'")
    attrs = attrs or relaxing_attributes(df, rfd, query)
    kinds = choose_metrics(df, attrs, metrics)
    out = df
    for c in attrs:
        out = _near_some(out, answers, c, kinds[c], rfd[c], mode)
    return out


def _key_arrays(tag: int, same: list[Column], reaches: list[Column]) -> Column:
    """One key per combination of the bands that a value reaches."""
    def grow(left: list[Column], bands: list[Column]) -> Column:
        if not left:
            return F.array(F.xxhash64(F.lit(tag), *same, *bands))
        if len(left) == 1:
            return F.transform(left[0], lambda x: F.xxhash64(F.lit(tag), *same, *bands, x))
        return F.flatten(F.transform(left[0], lambda x: grow(left[1:], [*bands, x])))

    return grow(reaches, [])


def _tagged_join(rfds: list[tuple[int, Rfd, list[str], dict]], need: list[str]) -> tuple[list[Column], Column, Column]:
    """(key per dependency of a row ``b*``, keys of an answer ``a*`` by ``tag``, the exact check by ``tag``)."""
    own, keys, checks = [], F.lit(None).cast("array<bigint>"), F.lit(False)
    for i, rfd, attrs, kinds in rfds:
        same_a, same_b, bands, reaches, cond = [], [], [], [], F.lit(True)
        for c in attrs:
            at, kind, t = need.index(c), kinds[c], rfd[c]
            a, b = F.col(f"a{at}"), F.col(f"b{at}")
            if t == INF:
                continue
            cond = cond & within(b, a, t, kind)
            if t == 0 and kind == "abs" or kind == "edit" and t < 1:
                clean = (lambda x: F.when(~F.isnan(x.cast("double")), x.cast("double"))) if kind == "abs" else (lambda x: x)
                # the hash passes over nulls, so they are told apart from the next value
                for values, x in ((same_a, a), (same_b, b)):
                    values += [clean(x), clean(x).isNull()]
            elif kind in ("abs", "days") and len(bands) < MAX_BANDS:
                band, reach = _band(kind, t, b, a)
                bands.append(F.coalesce(band, F.lit(NO_BAND)))
                reaches.append(F.transform(reach, lambda x: F.coalesce(x, F.lit(NO_BAND))))
        own.append(F.struct(F.lit(i).alias("tag"), F.xxhash64(F.lit(i), *same_b, *bands).alias("key")))
        keys = F.when(F.col("tag") == i, _key_arrays(i, same_a, reaches)).otherwise(keys)
        checks = F.when(F.col("tag") == i, cond).otherwise(checks)
    return own, keys, checks


def _shared(df: DataFrame, rfd: Rfd, attrs: list[str], extended: QuerySpec, metrics: Metrics | None) -> dict | None:
    """Metrics of the attributes if the dependency can take part in the shared join, else None."""
    if not all(p.is_plain() for p in extended.predicates):
        return None
    kinds = choose_metrics(df, attrs, metrics)
    keyed = any(rfd[c] != INF and (k in ("abs", "days") or k == "edit" and rfd[c] < 1) for c, k in kinds.items() if isinstance(k, str))
    return kinds if keyed and all(k in ("abs", "days", "edit") for k in kinds.values()) else None


def relax_counts(df: DataFrame, spec: QuerySpec, rfds: list[Rfd], mode: str = "distance",
                 extend_mode: str = "interval", metrics: Metrics | None = None) -> DataFrame:
    """``(rank, rfd_id, n_query, n_extended, n_relaxed)`` for each dependency.

    All dependencies share two scans of ``df``: the first one tags every answer with
    the dependencies whose extended query it satisfies and folds equal answers, the
    second one folds equal rows and meets the answers of each dependency under one
    key.  Dependencies that need a join to extend the query, that have only text
    thresholds, and ``mode='integers'`` go one by one.
    """
    frames, shared = [], []
    plain = mode == "distance" and all(p.is_plain() for p in spec.predicates)
    total = None
    for i, rfd in enumerate(rfds):
        extended = extend_query(spec, rfd, df, extend_mode, metrics=metrics)
        attrs = relaxing_attributes(df, rfd, spec)
        if plain and (kinds := _shared(df, rfd, attrs, extended, metrics)) is not None:
            shared.append((i, rfd, attrs, kinds, extended))
            continue
        answers = extended.apply(df)
        relaxed = relax_rows(df, answers, rfd, query=spec, mode=mode, metrics=metrics)
        counted = (answers.agg(F.count("*").alias("n_extended")).withColumn("rank", F.lit(i))
                   .join(relaxed.agg(F.count("*").alias("n_relaxed")).withColumn("rank", F.lit(i)), "rank")
                   .withColumn("rfd_id", F.lit(rfd.rfd_id)))
        frames.append(counted)
    if shared:
        per_rfd, n_query = _shared_counts(df, spec, shared)
        frames.append(per_rfd)
        total = F.lit(n_query)
    out = reduce(DataFrame.unionByName, frames).withColumn("k", F.lit(0))
    if total is None:
        out = out.join(spec.apply(df).agg(F.count("*").alias("n_query")).withColumn("k", F.lit(0)), "k")
    else:
        out = out.withColumn("n_query", total)
    return out.select("rank", "rfd_id", "n_query", "n_extended", "n_relaxed")


def _shared_counts(df: DataFrame, spec: QuerySpec, shared: list[tuple]) -> tuple[DataFrame, int]:
    need = list(dict.fromkeys(c for _, _, attrs, _, _ in shared for c in attrs))

    def tagged(i: int, attrs: list[str], cond: Column) -> Column:
        values = [(F.col(f"`{c}`") if c in attrs else F.lit(None).cast(df.schema[c].dataType)).alias(f"a{j}") for j, c in enumerate(need)]
        return F.when(cond, F.struct(F.lit(i).alias("tag"), *values))

    tags = [tagged(-1, [], spec.condition()), *[tagged(i, attrs, extended.condition()) for i, _, attrs, _, extended in shared]]
    marks = [f"a{j}" for j in range(len(need))]
    answers = materialize(df.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("x")).select("x.*")
                          .groupBy("tag", *marks).agg(F.count("*").alias("n")), "answers")
    n = {r.tag: r.n for r in answers.groupBy("tag").agg(F.sum("n").alias("n")).collect()}  # a number per dependency
    own, keys, check = _tagged_join([x[:4] for x in shared], need)
    wanted = answers.filter("tag >= 0").select(F.col("tag").alias("for"), *marks, F.explode(keys).alias("like"))
    rows = df.groupBy(*[F.col(f"`{c}`").alias(f"b{j}") for j, c in enumerate(need)]).agg(F.count("*").alias("n"))
    rows = rows.select("*", F.explode(F.array(*own)).alias("x")).select("*", "x.tag", "x.key").drop("x")
    near = rows.join(wanted, (F.col("tag") == F.col("for")) & (F.col("key") == F.col("like")) & check, "left_semi")
    relaxed = near.groupBy("tag").agg(F.sum("n").alias("n_relaxed"))
    ranks = df.sparkSession.createDataFrame([(i, rfd.rfd_id, n.get(i, 0)) for i, rfd, *_ in shared], "rank int, rfd_id string, n_extended long")
    return (ranks.join(relaxed, F.col("rank") == F.col("tag"), "left")
            .select("rank", "rfd_id", "n_extended", F.coalesce("n_relaxed", F.lit(0).cast("long")).alias("n_relaxed"))), n.get(-1, 0)


def relax_best(df: DataFrame, spec: QuerySpec, rfds: DataFrame, n: int = 3, mode: str = "distance",
               extend_mode: str = "interval", metrics: Metrics | None = None) -> DataFrame:
    """The dependency among the first ``n`` with the smallest relaxed answer that
    is strictly larger than the original one (no row if there is none)."""
    counts = relax_counts(df, spec, first_rfds(rfds, n), mode, extend_mode, metrics)
    return counts.filter(F.col("n_relaxed") > F.col("n_query")).orderBy("n_relaxed", "rank").limit(1)


def extent_pct(df: DataFrame, spec: QuerySpec, digits: int = 2) -> DataFrame:
    """One row: rows, answers and their percentage."""
    if all(p.is_plain() for p in spec.predicates):
        hits = F.count(F.when(spec.condition(), 1))
        out = df.agg(F.count("*").alias("n_rows"), hits.alias("n_answers"))
    else:
        out = df.agg(F.count("*").alias("n_rows")).withColumn("k", F.lit(0)).join(
            spec.apply(df).agg(F.count("*").alias("n_answers")).withColumn("k", F.lit(0)), "k").drop("k")
    return out.withColumn("pct", F.round(F.col("n_answers") * 100 / F.col("n_rows"), digits))


def mark_rows(df: DataFrame, selected: DataFrame, id_col: str, name: str = "selected") -> DataFrame:
    """Flag the rows whose id is in ``selected``."""
    ids = selected.select(F.col(f"`{id_col}`").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return (df.join(ids, F.col(f"`{id_col}`") == F.col("_id"), "left")
            .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_id", "_hit"))
