"""URL verdicts: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character the probability
``p_k = (c(ctx, x) + t(ctx) * p_{k-1}) / (c(ctx) + t(ctx))`` (Witten-Bell: c counts, t kinds of successors), from
order 0 up to ``order``; contexts that were never seen hand on to the shorter one.  A URL's score is the mean
logarithm of the ratio per character; the threshold is calibrated on URLs that no model has seen.

Counts are exact.  A character with its context of ``order`` bytes is one number (a gram), so the grams of all URLs are
a Spark table that grows with them; the counts of shorter contexts are sums of its rows, and a probability joins
that of the next shorter context.  URLs meet the ratios of their grams in blocks: a block asks for each gram once,
so a gram that all URLs have is one row per block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlModel:
    """``order``: at most 7, as a gram is a number of 64 bits; ``block``: rows that ask for ratios together."""

    order: int = 5
    block: int = 1024
    bins: int = 4096
    span: float = 8.0


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    known = F.col(url).isNotNull() & (at > 0)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Longest rule (``host/path`` -> ``allow`` or ``block``) that fits, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # longer ones are put around shorter ones
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _grams(urls: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(url, gram) of every character; a gram is the ``order`` bytes before it and its own, which is the lowest byte.

    A URL is its lower-case bytes between ``order`` start marks and one end mark.
    """
    raw = [(u or "").lower().encode() for u in urls]
    text = np.frombuffer(b"".join(b"\x02" * order + u + b"\x03" for u in raw), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in raw], np.int64)
    of = np.repeat(np.arange(len(raw)), sizes)
    first = np.cumsum(sizes + order) - sizes
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    gram = np.zeros(len(at), np.int64)
    for k in range(order, -1, -1):
        gram = (gram << 8) | text[at - k]
    return of, gram


def block_grams(rows: DataFrame, cfg: UrlModel) -> DataFrame:
    """``block, gram, good, bad``: the grams of a block's URLs, and how often its accepted and rejected URLs that the
    models learn from (``learn`` 1 and 0) have each."""
    def count(batches):
        for batch in batches:
            of, gram = _grams(batch.column(1).to_pylist(), cfg.order)
            block = batch.column(0).to_numpy()[of]
            learn = batch.column(2).to_numpy()[of]
            order = np.lexsort((gram, block))
            block, gram, learn = block[order], gram[order], learn[order]
            head = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (gram[1:] != gram[:-1])])) if len(gram) else order
            good, bad = (np.add.reduceat((learn == v).astype(np.int64), head) if len(head) else head for v in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(block[head]), pa.array(gram[head]), pa.array(good), pa.array(bad)],
                                             names=["block", "gram", "good", "bad"])

    return rows.select("block", "url", "learn").mapInArrow(count, "block long, gram long, good long, bad long")


def gram_ratios(grams: DataFrame, cfg: UrlModel) -> DataFrame:
    """``gram, ratio``: log ratio of the two models' probabilities for each gram of ``gram, good, bad``."""
    levels = [materialize(grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")]
    for k in range(cfg.order - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram"))
        levels.append(materialize(shorter.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams"))
    found = None
    for k, level in enumerate(reversed(levels)):
        # a context has at most 256 successors
        context = Window.partitionBy(F.shiftright("gram", 8))
        level = level.withColumns({f"{kind}_{v}": F.sum(x).over(context) for v in ("good", "bad") for kind, x in (
            ("seen", F.col(v)), ("kinds", (F.col(v) > 0).cast("long")))})
        if found is None:
            level = level.withColumns({"q_good": F.lit(1 / 257), "q_bad": F.lit(1 / 257)})
        else:
            rest = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
            level = level.withColumn("rest", rest).join(found.withColumnRenamed("gram", "rest"), "rest")
        found = level.select("gram", *[
            F.when(F.col(f"seen_{v}") > 0, (F.col(v) + F.col(f"kinds_{v}") * F.col(f"q_{v}")) / (F.col(f"seen_{v}") + F.col(f"kinds_{v}")))
            .otherwise(F.col(f"q_{v}")).alias(f"q_{v}") for v in ("good", "bad")])
    return found.select("gram", (F.log("q_good") - F.log("q_bad")).alias("ratio"))


def score_urls(rows: DataFrame, cfg: UrlModel) -> DataFrame:
    """``rows`` and ``score``: mean log ratio per character, positive if the accepted model fits better.

    ``rows`` are stored and have ``url``, ``block`` and ``learn``: 1 and 0 for accepted and rejected URLs that the
    models learn from, -1 for others.  A null URL counts as empty: one end mark.
    """
    asked = materialize(block_grams(rows, cfg), "asked")
    known = asked.select("block", "gram").join(gram_ratios(asked, cfg), "gram")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "score double"])

    def score(urls: pa.Table, known: pa.Table) -> pa.Table:
        gram, ratio = known["gram"].to_numpy(), known["ratio"].to_numpy()
        order = np.argsort(gram, kind="stable")
        gram, ratio = gram[order], ratio[order]
        n, scores = urls.num_rows, [np.zeros(0)]
        for lo in range(0, n, cfg.block):
            of, mine = _grams(urls["url"].slice(lo, cfg.block).to_pylist(), cfg.order)
            size = np.bincount(of)
            scores.append(np.bincount(of, ratio[np.searchsorted(gram, mine)]) / size)
        return urls.append_column("score", pa.array(np.concatenate(scores)))

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)


def calibrated(scored: DataFrame, cfg: UrlModel) -> float:
    """Threshold with the best mean of the two classes' accuracies, from ``score, good``; the middle of the best
    stretch of a histogram with a fixed number of bins.  0 if a class is missing."""
    bin_ = F.floor((F.greatest(F.lit(-cfg.span), F.least(F.lit(cfg.span), F.col("score"))) + cfg.span) * (cfg.bins / (2 * cfg.span)))
    hist = scored.groupBy(bin_.alias("b"), "good").count().collect()
    counts = np.zeros((2, cfg.bins + 1))
    for r in hist:
        counts[int(r.good), int(r.b)] += r["count"]
    if not counts.sum(axis=1).all():
        return 0.0
    below = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    gain = np.concatenate([[0.0], below[0] - below[1]])  # threshold at the lower edge of bin b
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = best * (2 * cfg.span / cfg.bins) - cfg.span
    return float((edges[0] + edges[np.flatnonzero(np.diff(np.append(best, 1 << 40)) > 1)[0]]) / 2)


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url",
               cfg: UrlModel = UrlModel()) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for every row.

    URLs that a rule decides are the accepted and rejected ones the models learn from; a fifth of them (by a hash
    of the URL) is kept for the calibration.  Null URLs and those without ``://`` have no host and path, fit no
    rule and are judged by their characters.  Without both kinds of ruled URLs every score is against an empty
    model and the threshold is 0.
    """
    host, path = url_parts("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "held": F.pmod(F.xxhash64("url"), F.lit(5)) == 0})
    learn = F.when(F.col("held") | F.col("ruled").isNull(), -1).otherwise((F.col("ruled") == "allow").cast("int"))
    block = F.expr(f"monotonically_increasing_id() div {cfg.block}")  # stored, so it stays the same
    rows = materialize(rows.withColumns({"learn": learn, "block": block}), "urls")
    scored = materialize(score_urls(rows, cfg), "scored")
    held = scored.filter("held AND ruled IS NOT NULL").select("score", (F.col("ruled") == "allow").alias("good"))
    threshold = calibrated(held, cfg)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
