"""Learned decision lists over text statistics, with DataFrame operations only.

``text_stats`` makes the statistics, ``learn_rules`` covers the labelled bad rows sequentially: a rule is a
conjunction of thresholds, grown on two thirds of the labelled rows by information gain and pruned on the rest;
the rows it covers leave the table before the next rule.  ``decision`` turns the ordered list into one Spark
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate",
            "distinct_rate")


def word_array(text: Column) -> Column:
    """Words of a text: maximal runs outside ``[\\x20\\x09-\\x0D]``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column would be computed again for every element of a lambda that names it, if the optimizer moves
    its definition there; a lambda variable cannot be moved.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_window_hashes(words: Column, k: int) -> Column:
    """Hash of every window of ``k`` consecutive words of an array; empty if there are fewer.

    ``words`` has to be a lambda variable (see ``let``).
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), window)).otherwise(F.array().cast("array<bigint>"))


def repeat_words(words: Column, k: int) -> Column:
    """Words in ``k``-word windows that occur twice or more in an array of words."""
    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(starts, i + 1), p + k) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def again(ranked: Column) -> Column:
        found = F.filter(ranked, lambda s, i: (s.h == F.get(ranked, i - 1).h) | (s.h == F.get(ranked, i + 1).h))
        return let(F.sort_array(F.transform(found, lambda s: s.i)), covered)

    def counted(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # only a text with a window found twice is sorted
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ranked, again)).otherwise(0)

    return let(word_window_hashes(words, k), counted)


def _removed(text: str, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def text_stats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the counts of the base rules and the features of the learned ones, one row per input row.

    Null texts count as empty: no words, all counts 0.  Repeated windows are found by 64-bit hashes inside
    one text.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    of_words = let(word_array(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
        repeat_words(w, 5).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        (F.char_length("text") - _removed("text", SPACES)).cast("long").alias("word_chars"),
        _removed("text", SYMBOLS).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "\\p{Lu}+", ""))).alias("n_upper"),
        _removed("text", "!").alias("n_bang"))
    d = d.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_bang")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_chars"), (F.col("n_symbols") / chars).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"), (F.col("n_upper") / chars).alias("upper_rate"),
        (F.col("n_bang") / chars).alias("bang_rate"), (F.col("n_distinct") / words).alias("distinct_rate"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = F.col(self.feature)
        return f > self.threshold if self.above else f <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Conjunction that marks rows as bad; ``covered`` and ``precision`` are from its pruning rows."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best(rows: DataFrame, features: list[str], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, float]:
    """Best next condition from one aggregation over (feature, interval): at most features x cuts rows."""
    def interval(f: str) -> Column:
        return F.size(F.filter(F.lit(cuts[f]), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)

    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), interval(f).alias("b")) for i, f in enumerate(features)]))
    table = (rows.select(bins.alias("x"), "bad").groupBy("x.f", "x.b")
             .agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect())
    best, best_gain, p0, n0 = None, 0.0, 0, 0
    for i, f in enumerate(features):
        counts = [[0, 0] for _ in range(len(cuts[f]) + 1)]
        for r in table:
            if r.f == i:
                counts[r.b] = [r.p, r.n - r.p]
        p0, n0 = (sum(c[k] for c in counts) for k in (0, 1))
        p = n = 0
        for k, cut in enumerate(cuts[f]):
            p, n = p + counts[k][0], n + counts[k][1]
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = _gain(p0, n0, a, b) if p0 and a + b < p0 + n0 else 0.0
                if gain > best_gain + 1e-9:
                    best_gain, best = gain, (Condition(f, above, cut), b)
    return best_gain, best[0] if best else None, best[1] if best else n0


def learn_rules(labelled: DataFrame, bad_col: str = "bad", id_col: str = "doc_id", features=FEATURES,
                cuts: int = 48, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.7) -> list[Rule]:
    """Ordered rules for the rows whose ``bad_col`` is 1.

    Every step is one aggregation over all labelled rows; only (feature, interval) counts reach the driver.
    Rows with a null label are ignored; no bad rows give an empty list.  Growing and pruning rows are told apart
    by a hash of ``id_col``, so repeated rows stay together.  Ties go to the first feature and smallest threshold.
    """
    features = list(features)
    rows = labelled.filter(F.col(bad_col).isNotNull()).select(
        F.col(bad_col).cast("int").alias("bad"), (F.pmod(F.xxhash64(F.col(id_col)), F.lit(3)) == 0).alias("prune"), *features)
    rows = materialize(rows, "labelled")
    steps = [i / cuts for i in range(1, cuts)]
    # thresholds: quantiles of each class, so a rare class has its own
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, steps, 10000).alias(f) for f in features]).collect()
    thresholds = {f: sorted({float(v) for r in found for v in r[f] or [] if v is not None}) for f in features}
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, conditions, covered = left.filter(~F.col("prune")), [], F.lit(True)
        while len(conditions) < max_conditions:
            gain, condition, negatives = _best(grow.filter(covered), features, thresholds)
            if condition is None or gain <= 0:
                break
            conditions.append(condition)
            covered = covered & condition.column()
            if negatives == 0:
                break
        if not conditions:
            break
        sums, prefix = [], F.lit(True)
        for i, c in enumerate(conditions):
            prefix = prefix & c.column()
            sums += [F.coalesce(F.sum(F.when(prefix, F.col("bad"))), F.lit(0)).alias(f"p{i}"),
                     F.count(F.when(prefix, 1)).alias(f"n{i}")]
        held = left.filter("prune").agg(*sums).first()
        value = [(2 * held[f"p{i}"] - held[f"n{i}"]) / held[f"n{i}"] if held[f"n{i}"] else -1.0 for i in range(len(conditions))]
        keep = max(range(len(conditions)), key=lambda i: (value[i], -i))
        precision = (value[keep] + 1) / 2
        if precision < min_precision:
            break
        rules.append(Rule(tuple(conditions[:keep + 1]), held[f"n{keep}"], precision))
        left = left.filter(~rules[-1].column())
    return rules


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that fits a row, as one ordered conditional expression; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(rule.column(), F.lit(i))
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality") -> DataFrame:
    """Statistics of every row with ``base_failed`` (below ten words, or more than a fifth of the words in
    repeated five-word windows), ``rule`` (of the learned list) and ``kept``.

    Rows with a null id are judged but never learned from; of an id's several labels the lowest counts.
    Without labels nothing is learned and only the base rules decide.
    """
    stats = materialize(text_stats(docs, text_col, id_col), "stats")
    truth = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    labelled = stats.join(truth, F.col(id_col) == F.col("_id")).withColumn("bad", (F.col("_label") == 0).cast("int"))
    rules = learn_rules(labelled, "bad", id_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed).withColumn("rule", decision(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
