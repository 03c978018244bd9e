"""Similarity joins: rows whose attributes lie within given thresholds.

Every join is an equi-join on derived keys followed by an exact check: numbers
and dates meet in bands of the threshold's width, equal values meet as they are,
strings meet through common deletion variants or through one of their rarest
q-grams (t edits touch at most q * t grams, so of the q * t + 1 rarest grams of
two strings one is common and moved by at most t places; Chaudhuri et al., ICDE
2006; Xiao et al., VLDB 2008).  The keys of one side are copied to the
neighbouring bands, the other side is never copied.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import INF, MICROS_PER_DAY, Metric, micros, within
from ..session import materialize

MAX_BANDS = 3
SALTS = 16
SLOTS = 1 << 16  # hash slots in which gram frequencies are counted; any order of grams gives the same pairs
HEAVY = 512  # strings of one gram key that meet in one cell
FEW = 1000  # rows that may meet each row on bands before other keys are looked for; different strings that can be such keys
DELETION_LENGTH = {1: 256, 2: 64}  # longest string per threshold that meets on deletions

Side = Callable[[str], Column]
Conditions = Mapping[str, tuple[Metric | DataFrame, float]]


def similar_values(df: DataFrame, column: str, source: str, t: float) -> DataFrame:
    """Distinct values of a string column within edit distance ``t`` of a constant."""
    c = F.col(f"`{column}`")
    return df.filter(F.levenshtein(c, F.lit(source), int(t)) >= 0).select(c).distinct()


def string_pairs(left: DataFrame, right: DataFrame, t: int) -> DataFrame:
    """``(l, r)``: pairs of the distinct strings of two one-column tables within
    edit distance ``t``.

    Two candidate schemes, chosen by the length of ``r``, both exact.  Short
    strings with t <= 2 meet on a common string left after at most t deletions
    on each side; such keys are shared by true neighbours only, so a prefix that
    all values have in common does no harm.  Other strings meet on rare grams,
    which such a prefix does not hold either.
    """
    a = left.toDF("l").dropna().distinct()
    b = right.toDF("r").dropna().distinct()
    if t <= 0:
        return a.join(b, F.col("l") == F.col("r"))
    near = (F.col("l") != F.col("r")) & (F.levenshtein("l", "r", t) >= 0)
    n, m = F.length("r"), F.length("l")
    short = DELETION_LENGTH.get(t, 0)
    found = [a.join(b, F.col("l") == F.col("r"))]
    if short:
        # keys are small but meet many partners: a fixed number of partitions
        # keeps adaptive execution from merging them into one task
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_l = _deletions(a.filter(m <= short + t), "l", t).repartition(parts, "key")
        by_r = _deletions(b.filter(n <= short), "r", t).repartition(parts, "key")
        found.append(by_l.join(by_r, "key").filter(near).select("l", "r"))
    first = max(t, short) + 1
    found.append(_gram_pairs(a.filter(m >= first - t), b.filter(n >= first), t, first).filter(near).select("l", "r"))

    if not short:
        # strings too short to be cut: spread one side, copy the other
        tiny_l = a.filter(m <= 2 * t).withColumn("salt", F.pmod(F.xxhash64("l"), F.lit(SALTS)).cast("int"))
        tiny_r = b.filter(n <= t).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found.append(tiny_l.join(tiny_r, "salt").filter(near).select("l", "r"))
    return reduce(DataFrame.unionByName, found).distinct()


def _deletions(values: DataFrame, column: str, t: int) -> DataFrame:
    """``(value, key)``: hashes of all strings left after at most t deletions."""
    out = values.select(column, F.col(column).alias("rest"))
    for _ in range(t):
        size = F.length("rest")
        spots = F.when(size > 0, F.sequence(F.lit(0), size)).otherwise(F.array(F.lit(0)))
        at = F.col("at")
        # place 0 deletes nothing
        cut = F.when(at == 0, F.col("rest")).otherwise(
            F.concat(F.expr("substring(rest, 1, at - 1)"), F.expr("substring(rest, at + 1)")))
        out = out.select(column, "rest", F.explode(spots).alias("at")).select(column, cut.alias("rest")).distinct()
    return out.select(column, F.xxhash64("rest").alias("key"))


def _gram_length(n: Column, t: int) -> Column:
    """Longest grams (3 at most) of which a string of length ``n`` has more than t edits can touch."""
    return F.when(n >= 3 * t + 3, 3).when(n >= 2 * t + 2, 2).otherwise(1)


def _rare_grams(values: DataFrame, column: str, slots: DataFrame, t: int) -> DataFrame:
    """``(value, n, q, g, p)``: the q * t + 1 rarest grams of every value and their places."""
    grams = _grams(values, column).join(F.broadcast(slots), "slot", "left")
    ranked = grams.groupBy(column, "q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", "p"))).alias("x"))
    return ranked.select(column, F.length(column).alias("n"), "q", F.explode(F.slice("x", 1, F.col("q") * t + 1)).alias("x")).select(
        column, "n", "q", "x.g", "x.p")


def _grams(values: DataFrame, column: str) -> DataFrame:
    c, q = F.col(column), F.col("q")
    spots = F.sequence(F.lit(1), F.length(c) - q + 1)
    one = F.transform(spots, lambda p: F.struct(F.xxhash64(q, F.substring(c, p, q)).alias("g"), p.alias("p")))
    return values.filter(F.length(c) >= q).select(column, "q", F.explode(one).alias("x")).select(
        column, "q", "x.g", "x.p", F.pmod("x.g", F.lit(SLOTS)).cast("int").alias("slot"))


def _gram_pairs(a: DataFrame, b: DataFrame, t: int, first: int) -> DataFrame:
    """Candidates ``(l, r)`` that share a rare gram at places and with lengths that differ by at most ``t``.

    Keys are gram, band of lengths and band of places; a key that more than ``HEAVY`` strings of ``b`` have is dealt to
    several cells, to each of which the strings of ``a`` are copied.
    """
    m = F.length("l")
    index = b.withColumn("q", _gram_length(F.length("r"), t))
    slots = materialize(_grams(index, "r").groupBy("slot").agg(F.count("*").alias("often")), "slots")  # at most SLOTS rows
    every = F.array_distinct(F.transform(F.sequence(F.greatest(m - t, F.lit(first)), m + t), lambda n: _gram_length(n, t)))
    probe = a.select("l", F.explode(every).alias("q"))
    width = t + 1
    band = lambda c: F.floor(c / width).cast("int")
    near = lambda c: F.sequence(band(c - t), band(c + t))
    right = materialize(_rare_grams(index, "r", slots, t).select(
        "r", "n", "p", F.xxhash64("q", "g", band(F.col("n")), band(F.col("p"))).alias("key")), "grams")
    left = (_rare_grams(probe, "l", slots, t).select("l", F.col("n").alias("m"), "q", "g", F.col("p").alias("p_l"), F.explode(near(F.col("n"))).alias("by_n"))
            .select("*", F.explode(near(F.col("p_l"))).alias("by_p")).select("l", "m", "p_l", F.xxhash64("q", "g", "by_n", "by_p").alias("key")))
    keys = materialize(right.groupBy("key").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("cells")), "keys")
    heavy = keys.filter("cells > 1")
    left = left.join(keys.select("key"), "key", "left_semi")  # most probes find nothing
    if heavy.isEmpty():
        met = left.join(right, "key")
    else:
        spread = left.join(heavy, "key", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"))
        dealt = right.join(heavy, "key", "left").withColumn("cell", F.pmod(F.xxhash64("r"), F.coalesce("cells", F.lit(1))).cast("int"))
        met = spread.join(dealt, ["key", "cell"])
    return met.filter((F.abs(F.col("m") - F.col("n")) <= t) & (F.abs(F.col("p_l") - F.col("p")) <= t)).select("l", "r").distinct()


def _band(kind: Metric, t: float, left: Column, right: Column) -> tuple[Column, Column]:
    """Band of a left value; array of the bands a right value reaches."""
    if kind == "days":
        left, right = micros(left).cast("double"), micros(right).cast("double")
        width = (int(t) + 1) * float(MICROS_PER_DAY)
        slack = F.lit(1.0)
    else:
        # NaN meets null, an infinite value only itself
        left, right = (F.when(~F.isnan(x), x) for x in (left.cast("double"), right.cast("double")))
        width = float(t)
        slack = F.abs(right) * 1e-12 + 1e-6
    reach = F.sequence(F.floor((right - width - slack) / width), F.floor((right + width + slack) / width))
    reach = F.when(F.abs(right) == INF, F.array(F.floor(right / width))).otherwise(reach)
    none = F.array(F.lit(None).cast("bigint"))
    return F.floor(left / width), F.when(right.isNull(), none).otherwise(reach)


def _listed(right: DataFrame, column: str, pairs: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """Copy the right rows to every left value that ``pairs(l, r)`` calls similar."""
    c = F.col(f"`{column}`")
    nulls = right.filter(c.isNull()).limit(1).select(
        F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("r"))
    near = pairs.select("l", "r").unionByName(nulls).toDF(name, "_value")
    return right.join(near, c.eqNullSafe(F.col("_value"))).drop("_value"), F.col(name)


def _fewer_by_strings(l: DataFrame, r: DataFrame, column: str, t: int, bands: list[tuple[str, Metric, float]]) -> DataFrame | None:
    """The similar strings of a column, if fewer rows meet on them than on the bands of numbers; else None.

    The rows that meet on a band are estimated from the width of the middle 80 % of its values, those that meet on
    strings are counted by value.  It only chooses the keys of the join; all thresholds are checked on either way.
    """
    if t not in DELETION_LENGTH:
        return None
    a, b = F.col(f"`{column}_l`"), F.col(f"`{column}_r`")
    ends = []
    for c, kind, _ in bands:
        v = F.col(f"`{c}_r`")
        ends.append(F.percentile_approx(micros(v).cast("double") if kind == "days" else F.when(F.abs(v.cast("double")) < INF, v.cast("double")), F.array(F.lit(0.1), F.lit(0.9))))
    found = r.agg(F.count("*").alias("n"), F.approx_count_distinct(b).alias("words"), *[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    share = 1.0
    for i, (_, kind, width) in enumerate(bands):
        ends_of = found[f"e{i}"] or [0.0, 0.0]
        width = (int(width) + 1) * float(MICROS_PER_DAY) if kind == "days" else width
        share *= min(1.0, 2.4 * width / (ends_of[1] - ends_of[0])) if ends_of[1] > ends_of[0] else 1.0
    if found["n"] * share < FEW or found["words"] < FEW:
        return None
    by_l, by_r = (materialize(x.groupBy(c.alias(name)).agg(F.count("*").alias(f"n_{name}")), "words") for x, c, name in ((l, a, "l"), (r, b, "r")))
    near = materialize(string_pairs(by_l.select("l"), by_r.select("r"), t), "near")
    met = near.unionByName(near.sparkSession.createDataFrame([(None, None)], "l string, r string")).alias("m")
    met = met.join(by_l.withColumnRenamed("l", "l0"), F.col("m.l").eqNullSafe(F.col("l0"))).join(by_r.withColumnRenamed("r", "r0"), F.col("m.r").eqNullSafe(F.col("r0")))
    meetings = met.agg(F.sum(F.col("n_l").cast("double") * F.col("n_r"))).first()[0] or 0.0
    rows = by_l.agg(F.sum("n_l")).first()[0] or 0
    return near if meetings < rows * found["n"] * share else None


def similarity_join(left: DataFrame, right: DataFrame, on: Conditions, how: str = "inner",
                    extra: Callable[[Side, Side], Column] | None = None, salts: int = SALTS) -> DataFrame:
    """Join rows that are within ``on[col] = (metric, threshold)`` on every column.

    A metric may also be a table ``(l, r)`` that lists the similar values, such as
    the result of ``taxonomy_pairs``.

    ``how`` is ``inner`` (columns get the suffixes ``_l`` and ``_r``),
    ``left_semi`` or ``left_anti``.  The bands of the right side are copied, so
    the smaller side belongs there.  The planner broadcasts it only below its
    own size limit; otherwise both sides are shuffled and adaptive execution
    splits skewed keys of the left side.  ``extra(l, r)`` adds a condition; its
    arguments give the column of a name on either side.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    cols = right.columns if how == "inner" or extra is not None else list(on)
    r = right.select(*[F.col(f"`{c}`").alias(f"{c}_r") for c in cols])
    if how != "inner":
        maps = any(kind == "taxonomy" for kind, _ in on.values())
        r = r if maps else r.distinct()
    lcol = {c: F.col(f"`{c}_l`") for c in left.columns}
    l = left.select(*[F.col(f"`{c}`").alias(f"{c}_l") for c in left.columns])

    keys: list[Column] = []
    checks: list[Column] = []
    edits: list[tuple[int, str]] = []
    bands: list[tuple[str, Metric, float]] = []
    l0, r0 = l, r
    for i, (c, (kind, t)) in enumerate(on.items()):
        a, b = lcol[c], F.col(f"`{c}_r`")
        if t == INF:
            continue
        if isinstance(kind, DataFrame):
            r, key = _listed(r, f"{c}_r", kind, f"_like{i}")
            keys.append(a.eqNullSafe(key))
            continue
        if kind in ("abs", "edit") and (t == 0 or (kind == "edit" and t < 1)):
            if kind == "abs" and isinstance(left.schema[c].dataType, (T.DoubleType, T.FloatType)):
                a, b = (F.when(~F.isnan(x), x) for x in (a, b.cast("double")))
            keys.append(a.eqNullSafe(b))
        elif kind in ("abs", "days") and len(bands) < MAX_BANDS:
            bands.append((c, kind, t))
            own, reach = _band(kind, t, a, b)
            l = l.withColumn(f"_band{i}", own)
            r = r.withColumn(f"_reach{i}", F.explode(reach))
            keys.append(F.col(f"_band{i}").eqNullSafe(F.col(f"_reach{i}")))
            checks.append(within(a, b, t, kind))
        else:
            if kind == "edit":
                edits.append((int(t), c))
            checks.append(within(a, b, t, kind))
    near = None
    if edits and not keys:
        near = string_pairs(l.select(f"`{min(edits)[1]}_l`"), r.select(f"`{min(edits)[1]}_r`"), min(edits)[0])
    elif edits and len(keys) == len(bands):
        near = _fewer_by_strings(l0, r0, *reversed(min(edits)), bands)
        if near is not None:
            l, r, keys = l0, r0, []
    if near is not None:
        t, c = min(edits)
        r, key = _listed(r, f"{c}_r", near, "_like")
        keys.append(lcol[c].eqNullSafe(key))
        checks = [within(lcol[o], F.col(f"`{o}_r`"), on[o][1], on[o][0])
                  for o in on if o != c and on[o][1] != INF]
    if not keys:
        names = [f"{c}_l" for c in left.columns if c not in on or on[c][0] != "taxonomy"]
        l = l.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(salts)).cast("int")
                         if names else F.lit(0))
        r = r.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append(F.col("_salt") == F.col("_spread"))
    if extra is not None:
        checks.append(extra(lambda c: F.col(f"`{c}_l`"), lambda c: F.col(f"`{c}_r`")))
    cond = keys[0]
    for k in keys[1:] + checks:
        cond = cond & k
    joined = l.join(r, cond, how)
    if how == "inner":
        return joined.select(*[F.col(f"`{c}_l`") for c in left.columns], *[F.col(f"`{c}_r`") for c in cols])
    return joined.select(*[lcol[c].alias(c) for c in left.columns])
