"""Token budgets for a domain-language-source tree and the documents that fill them; DataFrame operations only.

A tree is a table with one row per leaf: one column per level and one weight column per level (``w_<level>``,
the weight of the node among its siblings).  Budgets go down level by level: siblings share their parent's budget
in proportion to their weights, a node never gets more than its leaves can give (tokens x epochs), and what one
cannot take goes to its siblings first; only when all of them are full does the rest stay with the parent's
siblings, because the parent was then capped itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

BUCKETS = 4096


def _fill(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``got``: water filling of ``budget`` over the children of each parent by ``weight`` up to ``cap``.

    Sorted by cap / weight, the first children are full; the others share what is left by weight.  The tree is
    given by the user and bounds every window.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    by = w.orderBy("_ratio", "_tie")
    out = children.withColumn("_ratio", ratio).withColumn("_before", F.coalesce(
        F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col(budget) - F.col("_before")) / F.col("_rest")
    # a row is full while its cap / weight is below the level of the water; the first one that is not
    # sets it, and later rows would only give lower levels
    out = out.withColumn("_level", F.when((F.col("_rest") > 0) & (F.col("_ratio") >= level), level))
    out = out.withColumn("_water", F.max("_level").over(w))
    got = F.when(F.col("weight") <= 0, 0.0).when(F.col("_water").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.greatest(F.col("_water"), F.lit(0.0)) * F.col("weight")))
    return out.withColumn("got", got).drop("_ratio", "_before", "_rest", "_level", "_water", "_tie")


def leaf_budgets(leaves: DataFrame, levels: list[str], total: float | Column, max_epochs: int) -> DataFrame:
    """``leaves (levels, w_<level>, tokens)`` with ``budget`` per leaf.

    Leaves without tokens get 0; weights that are null or not positive count as 0.  ``total`` may be a column of
    one value.  If all leaves together cannot give ``total``, every leaf with a positive weight is full.
    """
    node = leaves.select(*levels, *[F.greatest(F.coalesce(F.col(f"w_{c}"), F.lit(0.0)), F.lit(0.0)).cast("double").alias(f"w_{c}")
                                    for c in levels], (F.coalesce("tokens", F.lit(0)) * max_epochs).cast("double").alias("leaf_cap"))
    for c in levels:  # a leaf under a node of weight 0 can give nothing
        node = node.withColumn("leaf_cap", F.when(F.col(f"w_{c}") > 0, F.col("leaf_cap")).otherwise(0.0))
    out, budget = node, total if isinstance(total, Column) else F.lit(float(total))
    out = out.withColumn("_b0", budget.cast("double"))
    for depth, c in enumerate(levels):
        path = levels[:depth + 1]
        nodes = out.groupBy(*path).agg(F.max(f"w_{c}").alias("weight"), F.sum("leaf_cap").alias("cap"),
                                       F.max(f"_b{depth}").alias("_b"))
        nodes = nodes.withColumn("_tie", F.struct(*path))
        filled = _fill(nodes, path[:-1], "_b").select(*[F.col(p).alias(f"_{p}") for p in path], F.col("got").alias(f"_b{depth + 1}"))
        same = F.lit(True)
        for p in path:
            same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
        out = out.join(filled, same).drop(*[f"_{p}" for p in path])
    return out.select(*levels, F.round(F.col(f"_b{len(levels)}"), 6).alias("budget"))


def epoch_rank(seed: int, epoch: Column, key: Column) -> Column:
    """Position of a row in an epoch's order, as 32 hexadecimal digits that any SQL engine can recompute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def mix_sources(docs: DataFrame, weights: DataFrame, levels: list[str], id_col: str, tokens_col: str,
                total: float | Column | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = 7,
                epochs_col: str = "epochs") -> DataFrame:
    """``docs`` rows with a positive number of epochs (``epochs_col``, times the row is read), the rest are left out.

    ``weights`` is the tree; rows of leaves that it does not name are left out.  The budget is ``total`` tokens,
    or ``share`` of all tokens of the named leaves.  A leaf reads its rows as often as its budget holds all of
    them; of the next epoch it reads a prefix of that epoch's seeded order: every row that begins before the
    budget is used up, so a leaf exceeds its budget by less than one row.

    The prefix is found without sorting a leaf: token sums of 4096 hash ranges say in which range the budget
    ends, and only that range is ordered.  Null or negative tokens count as 0, null level values match null in the
    tree, equal ids of a leaf share a rank and are taken together, and an empty table stays empty.
    """
    keys = [f"k{i}" for i in range(len(levels))]
    tokens = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long").alias("tokens")
    own = [F.col(c).alias(k) for c, k in zip(levels, keys, strict=True)]
    rank_id = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("rank_id")
    rows = materialize(docs.select(*own, tokens, rank_id), "tokens")
    avail = rows.groupBy(*keys).agg(F.sum("tokens").alias("sum"))

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """Join on the level values, null equal to null; the right side has one row per leaf of the tree."""
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return left.join(right.withColumnsRenamed({k: f"r_{k}" for k in keys}), cond, how).drop(*[f"r_{k}" for k in keys])

    tree = weights.groupBy(*own).agg(*[F.max(f"w_{c}").alias(f"w_{k}") for c, k in zip(levels, keys, strict=True)])
    leaves = materialize(matched(tree, avail, "left").select(
        *tree.columns, F.coalesce("sum", F.lit(0)).alias("tokens")), "leaves")
    if total is None:
        total = float(leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    plan = matched(leaf_budgets(leaves, keys, total, max_epochs), leaves.select(*keys, "tokens"))
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor((F.col("budget") + 1e-6) / F.col("tokens")))).otherwise(0)
    plan = plan.withColumn("full", whole.cast("int")).withColumn("rest", F.when(
        F.col("full") < max_epochs, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(0.0))
    plan = materialize(plan.select(*keys, "full", "rest"), "plan")  # one row per leaf of the given tree

    def ranked(df: DataFrame) -> DataFrame:
        return (matched(df, plan).withColumn("rank", epoch_rank(seed, F.col("full") + 1, F.col("rank_id")))
                .withColumn("bucket", F.conv(F.substring("rank", 1, 3), 16, 10).cast("int")))

    named = ranked(rows)
    sums = named.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("held"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    edge = sums.filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("held") >= F.col("rest")))
    edge = materialize(edge.groupBy(*keys).agg(F.min("bucket").alias("edge"), F.min_by("start", "bucket").alias("base")), "edges")
    # rows of the one range in which the budget ends; equal ranks are one step
    last = (matched(named, edge).filter("bucket = edge").groupBy(*keys, "rank")
            .agg(F.sum("tokens").alias("held"), F.max("base").alias("base"), F.max("rest").alias("rest")))
    inner = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cut = (last.withColumn("start", F.col("base") + F.coalesce(F.sum("held").over(inner), F.lit(0)))
           .filter("start < rest").groupBy(*keys).agg(F.max("rank").alias("cut")))
    plan = materialize(matched(matched(plan, edge, "left"), cut, "left"), "plan")

    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != epochs_col]).alias("row"), *own, rank_id)
    # without an edge the rest is more than all rows hold (or nothing)
    taken = F.when(F.col("rest") <= 0, False).when(F.col("edge").isNull(), True).otherwise(
        (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("rank") <= F.col("cut"))))
    out = ranked(whole_rows).withColumn("epochs", F.col("full") + F.when(taken, 1).otherwise(0))
    return out.filter("epochs > 0").select("row.*", F.col("epochs").alias(epochs_col))
