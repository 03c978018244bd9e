"""Benchmark passages in documents: SimHash of item-sized windows, with DataFrame operations only.

1. Items and documents become five-word shingle hashes.  A shingle's weight is ``1 + ln((1 + N) / (1 + df)) /
   ln(1 + N)`` over the N items and 2 if no item has it, as a whole number of billionths, so sums are exact.
2. A window of an item's size can only be similar if the shingles it shares with items of that size weigh enough.
   Running sums over the known shingles of a text find the texts and sizes that have such a window.
3. There every start is looked at, repeated shingles counted once.  A start gives way to its neighbour if that window
   has all known shingles this one has and is not heavier, since then no item is less similar to the neighbour.  So
   of the windows around a passage few remain, and among them a best one for every item.
4. Each distinct window and each item gets a 128-bit weighted SimHash.  Fingerprints are cut into eight blocks of 16
   bits; within ``radius`` 31 some block differs in at most three bits, which one flip on the windows' side and two on
   the items' side reach, so an equality join finds every pair of fingerprints within the radius.  About one random
   pair in twelve shares a block.  Sets of equal weights at similarity 0.8 differ in 19.4 of 128 bits on average with
   a deviation of 4.1, so the radius keeps 0.998 of those right at the threshold, and more above it.
5. Candidates are verified by exact weighted Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .rules import let, word_array, word_window_hashes

BLOCKS, BLOCK_BITS = 8, 16
WINDOW_FLIPS = 1  # the rest of the radius is on the items' side
UNIT = 1_000_000_000  # of weights


@dataclass(frozen=True)
class Decontam:
    """``broadcast_rows`` bounds the item shingles (24 bytes each) that may be broadcast; more are joined by
    a shuffle."""

    shingle: int = 5
    threshold: float = 0.8
    radius: int = 31
    broadcast_rows: int = 1_000_000


def simhash(shingles: str) -> Column:
    """128-bit fingerprint, as two longs, of an array of ``struct<h long, w long>``."""
    def fingerprint(found: Column) -> Column:
        def half(hashed: str) -> Column:
            def bit(b: Column) -> Column:
                score = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.when(F.getbit(x[hashed], b) == 1, x.w).otherwise(-x.w))
                return F.when(score > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")

            bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
            return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))

        return F.array(half("h"), half("g"))

    return let(F.transform(F.col(shingles), lambda x: F.struct(x.h.alias("h"), F.xxhash64(x.h, F.lit(1)).alias("g"), x.w.alias("w"))), fingerprint)


def _blocks(fp: str, flips: int) -> Column:
    """Every (block, value) whose value is within ``flips`` bits of the fingerprint's block."""
    masks = [sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(BLOCK_BITS), n)]

    def block(i: int) -> Column:
        value = F.shiftrightunsigned(F.get(fp, F.lit(i // 4)), i % 4 * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1))
        return F.transform(F.lit(masks), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[block(i) for i in range(BLOCKS)]))


def _hashed(df: DataFrame, text_col: str, k: int, *keep: Column) -> DataFrame:
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = let(word_array(text), lambda w: F.struct(F.size(w).alias("n"), word_window_hashes(w, k).alias("hs")))
    return df.select(*keep, found.alias("x")).select("*", "x.n", "x.hs").drop("x")


def _near_starts(hits: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """``doc, th, len, n, lo, hi``: texts and sizes with a window whose known shingles may weigh enough, and the range
    of such windows that begin with a known shingle or end the text.  Any other one can be moved to one of these
    without losing a known shingle, by less than a window's width."""
    last = F.greatest(F.col("len") - F.col("n"), F.lit(0))
    tails = (hits.groupBy("doc", "th", "len", "n").agg(F.max("pos").alias("end")).filter(F.col("end") > last)
             .select("doc", "th", "len", last.alias("pos"), F.lit(0).cast("long").alias("w"), "n"))
    spots = hits.unionByName(tails).groupBy("doc", "th", "len", "n", "pos").agg(F.max("w").alias("w"))
    # weight inside [start, start + n - k]: running sum at the window's end minus the sum before its start
    kinds = F.when(F.col("pos") <= last, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    events = spots.select("doc", "th", "len", "n", F.col("pos").alias("start"), "w", F.explode(kinds).alias("kind"))
    place = F.col("start") + F.when(F.col("kind") == 2, F.col("n") - k).otherwise(0)
    running = F.sum(F.when(F.col("kind") == 1, F.col("w")).otherwise(0)).over(
        Window.partitionBy("doc", "th", "n").orderBy(place, "kind").rowsBetween(Window.unboundedPreceding, 0))
    windows = (events.withColumn("sum", running).filter("kind <> 1").groupBy("doc", "th", "len", "n", "start")
               .agg((F.max("sum") - F.min("sum")).alias("inner")))
    return windows.join(need, "n").filter("inner >= need").groupBy("doc", "th", "len", "n").agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"))


def _best_starts(near: DataFrame, arrays: DataFrame, lookup: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """``doc, th, n, start`` of the windows that give way to no neighbour (see the module text).

    A shingle at ``p`` whose like stood last at ``prev`` counts in the starts from ``prev + 1`` to ``p``, so weights of
    all windows are running sums of two events a shingle.
    """
    text = ["doc", "th"]
    m = F.least("n", "len") - k + 1
    spots = near.join(arrays.withColumnsRenamed({x: f"of_{x}" for x in text}),
                      F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th"))).drop("of_doc", "of_th")
    spots = spots.select(*text, "n", "lo", "hi", m.alias("m"), F.greatest(F.col("len") - F.col("n"), F.lit(0)).alias("last"),
                         F.explode(F.transform(F.slice("hs", F.greatest(F.col("lo") - m, F.lit(1)), F.col("hi") - F.col("lo") + 2 * m + 3), lambda h, i: F.struct(
                             h.alias("h"), (i + F.greatest(F.col("lo") - m, F.lit(1)) - 1).alias("p")))).alias("s")).select("*", "s.h", "s.p").drop("s")
    spots = spots.join(lookup, "h", "left").select(
        *text, "n", "lo", "hi", "m", "last", "h", "p", F.coalesce("w", F.lit(2 * UNIT)).alias("w"),
        F.coalesce(F.array_contains("sizes", F.col("n")), F.lit(False)).alias("known"))
    like = Window.partitionBy(*text, "n", "h").orderBy("p")
    p, before, after = F.col("p"), F.coalesce(F.lag("p").over(like), F.lit(-1 << 30)), F.coalesce(F.lead("p").over(like), F.lit(1 << 30))
    spots = spots.withColumns({"before": before, "after": after})
    known, zero, no = F.col("known"), F.lit(0).cast("long"), F.lit(False)

    def event(at: Column, w: Column = zero, inner: Column = zero, lost: Column = no, won: Column = no, tail: Column = no, real: Column = no) -> Column:
        return F.struct(at.cast("int").alias("start"), w.alias("w"), inner.alias("inner"), lost.alias("lost"), won.alias("won"), tail.alias("tail"), real.alias("real"))

    first = F.greatest(F.col("before") + 1, p - F.col("m") + 1, F.lit(0))
    own = F.when(known, F.col("w")).otherwise(zero)
    events = F.array(
        event(first, F.col("w"), own), event(p + 1, -F.col("w"), -own),
        event(p, lost=known & (F.col("after") > p + F.col("m")), real=F.lit(True)),  # the next start loses it
        event(p - F.col("m"), won=known & (F.col("before") < p - F.col("m"))),  # the next start wins it
        event(p - F.col("m") + 1, tail=known & (F.col("before") < p - F.col("m"))))  # the start before loses it
    rows = spots.select(*text, "n", "lo", "hi", "m", "last", F.explode(events).alias("e")).select("*", "e.*").drop("e")
    starts = rows.groupBy(*text, "n", "lo", "hi", "m", "last", "start").agg(
        F.sum("w").alias("w"), F.sum("inner").alias("inner"), *[F.max(x).alias(x) for x in ("lost", "won", "tail", "real")])
    order = Window.partitionBy(*text, "n").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.withColumns({"w": F.sum("w").over(upto), "inner": F.sum("inner").over(upto)})
    # rows of every start between lo - m and hi + 1 are there, since a shingle stands at each
    right, left = F.lead("w").over(order), F.lag("w").over(order)
    starts = starts.withColumns({"right": right, "left": left})
    can_right = F.col("start") < F.least("last", F.col("hi"))
    goes_right = can_right & ~F.col("lost") & ((F.col("right") < F.col("w")) | ((F.col("right") == F.col("w")) & F.col("won")))
    can_left = F.col("start") > F.greatest(F.lit(0), F.col("lo") - F.col("m"))
    goes_left = can_left & ~F.col("tail") & (F.col("left") <= F.col("w"))
    inside = (F.col("start") >= F.greatest(F.lit(0), F.col("lo") - F.col("m"))) & (F.col("start") <= F.least("last", F.col("hi")))
    return (starts.filter(inside & F.col("real") & ~F.coalesce(goes_right, no) & ~F.coalesce(goes_left, no))
            .join(need, "n").filter("inner >= need").select(*text, "n", "m", "start"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", cfg: Decontam = Decontam(),
                  with_key: bool = False) -> DataFrame:
    """``id_col, item_id, similarity, start, n_words``: one row per document and item that it has, with a best
    window (the first of the equally good ones that remain in step 3).

    Words are compared in lower case.  Items below five words have no shingles and match nothing; null texts are
    empty.  Rows with a null id are reported under null, items with a null id are left out.  Ids keep their types;
    other columns play no part.  Repeated rows and repeated items give one row each.  A document shorter than an item
    is one window.  No items or documents give an empty table.  ``with_key`` tells documents apart by id and text and
    adds ``text_key``, the MD5 of the text, so of rows that share an id (or have none) only those with the passage are
    named.
    """
    k = cfg.shingle
    # the outer forms of explode below keep the optimizer from computing the arrays once more for a filter
    items = _hashed(benchmark, item_text, k, F.col(item_id).alias("item"))
    items = materialize(items.select("item", "n", F.array_distinct("hs").alias("hs")), "items")
    items = items.filter("n >= 5 AND item IS NOT NULL").distinct()
    n_items = F.lit(float(items.select("item").distinct().count()))
    weight = 1 + F.greatest(F.log((1 + n_items) / (1 + F.col("df"))), F.lit(0.0)) / F.log(1 + F.greatest(n_items, F.lit(1.0)))
    lookup = materialize(items.select("item", "n", F.explode("hs").alias("h")).groupBy("h").agg(
        F.countDistinct("item").alias("df"), F.collect_set("n").alias("sizes")).select(
        "h", F.rint(weight * UNIT).cast("long").alias("w"), "sizes"), "lookup")
    small = lookup.count() <= cfg.broadcast_rows

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def fingerprinted(rows: DataFrame, *by: str) -> DataFrame:
        sets = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("set"), F.sum("w").alias("total"))
        return sets.withColumn("fp", simhash("set"))

    targets = materialize(fingerprinted(items.select("item", "n", F.explode("hs").alias("h")).join(
        sized(lookup.select("h", "w")), "h"), "item", "n"), "targets")
    need = materialize(targets.groupBy("n").agg((F.min("total") * cfg.threshold - 1e-9 * UNIT).alias("need")), "need")

    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    th = F.unhex(F.md5("text")) if with_key else F.xxhash64("text")
    own_text = ["th"] if with_key else []
    hits = _hashed(texts, "text", k, F.col("doc"), th.alias("th")).select("doc", "th", "n", F.posexplode_outer("hs").alias("pos", "h"))
    hits = hits.withColumnRenamed("n", "len").join(sized(lookup), "h").distinct()
    # distinct: equal rows of the input are one
    hits = materialize(hits.select("doc", "th", "len", "pos", "w", F.explode("sizes").alias("n")), "hits")
    near = materialize(_near_starts(hits, need, k), "near")

    # only documents with such windows are hashed again; Spark picks the join by the exact size of their list
    some = texts.join(near.select(F.col("doc").alias("of"), F.col("th").alias("key")).distinct(),
                      F.col("doc").eqNullSafe(F.col("of")) & (th == F.col("key")), "left_semi")
    arrays = materialize(_hashed(some, "text", k, F.col("doc"), th.alias("th")).drop("n").dropDuplicates(["doc", "th"]), "arrays")
    starts = _best_starts(near, arrays, sized(lookup), need, k)
    windows = (starts.join(arrays.withColumnsRenamed({"doc": "of_doc", "th": "of_th"}),
                           F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th")))
               .select("doc", "th", "n", "start", F.array_sort(F.array_distinct(F.slice("hs", F.col("start") + 1, F.col("m")))).alias("hs")))
    # copies of a passage are one window from here on
    windows = materialize(windows.withColumn("set_id", F.md5(F.concat_ws(",", "hs"))), "windows")
    sets = windows.groupBy("n", "set_id").agg(F.first("hs").alias("hs")).select("n", "set_id", F.explode("hs").alias("h"))
    sets = sets.join(sized(lookup.select("h", "w")), "h", "left").withColumn("w", F.coalesce("w", F.lit(2 * UNIT)))
    prints = materialize(fingerprinted(sets, "n", "set_id"), "prints")

    def keyed(df: DataFrame, flips: int, *keep: Column) -> DataFrame:
        return df.select("n", *keep, F.explode(_blocks("fp", flips)).alias("b")).select("*", "b.block", "b.value").drop("b")

    probes = keyed(prints, WINDOW_FLIPS, F.col("fp"), F.col("set_id"))
    index = keyed(targets, cfg.radius // BLOCKS - WINDOW_FLIPS, F.col("fp").alias("item_fp"), F.col("item"))
    apart = F.bit_count(F.col("fp")[0].bitwiseXOR(F.col("item_fp")[0])) + F.bit_count(F.col("fp")[1].bitwiseXOR(F.col("item_fp")[1]))
    pairs = probes.join(index, ["n", "block", "value"]).filter(apart <= cfg.radius).select("n", "set_id", "item").distinct()
    cand = materialize(pairs, "candidates")

    weights = prints.select("n", "set_id", F.explode("set").alias("s")).select("n", "set_id", "s.h", "s.w")
    of_item = targets.select("n", "item", F.explode("set").alias("s")).select("n", "item", "s.h")
    common = (cand.join(weights, ["n", "set_id"]).join(of_item, ["n", "item", "h"]).groupBy("n", "set_id", "item")
              .agg(F.sum("w").alias("common")))
    scored = (common.join(prints.select("n", "set_id", "total"), ["n", "set_id"])
              .join(targets.select("n", "item", F.col("total").alias("item_total")), ["n", "item"])
              .withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
              .filter(F.col("similarity") >= cfg.threshold - 1e-9))
    found = windows.select("doc", "th", "n", "start", "set_id").join(scored.select("n", "set_id", "item", "similarity"), ["n", "set_id"])
    best = found.groupBy("doc", *own_text, "item").agg(F.max(F.struct(
        F.round("similarity", 9).alias("similarity"), (-F.col("start")).alias("at"), "n")).alias("m"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "m.similarity",
                       (-F.col("m.at")).alias("start"), F.col("m.n").alias("n_words"), *[F.col(x).alias("text_key") for x in own_text])
