"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; the label of a line depends
on the label before it.  Training lines carry the label of their document.  The length-weighted mean of the
forward-backward marginals of "good" is the document's raw quality, which a logistic calibration on the training
documents turns into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .words import Powers, chunks, words_of

FEATURES = ("log_chars", "log_words", "word_chars", "upper", "digits", "symbols", "bars", "bangs", "letters", "same_word",
            "known_words", "ends", "seen_before", "log_lines")
_KINDS = np.zeros(256, np.uint8)  # bit sets of byte classes
for _bit, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!",
                               b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _KINDS[list(_bytes)] |= 1 << _bit
_KINDS[128:] |= 1 << 5


@dataclass(frozen=True)
class LineCrf:
    """Parameters of training: ``sample`` labelled documents per class, a run of at most ``sample_lines`` lines of
    each, are all that the driver ever gets; scoring has no limits."""

    sample: int = 1500
    sample_lines: int = 400
    steps: int = 300
    rate: float = 0.05
    l2: float = 1e-3


def line_features(raw: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bytes, features) of every line with a word; a line ends at a line feed or with its text."""
    words = words_of(raw, offsets, powers)
    n_words = len(words.starts)
    if not n_words:
        return np.empty(0, np.int64), np.empty(0), np.empty((0, len(FEATURES)), np.float32)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    doc = words.doc_of()
    line = breaks[words.starts]
    new = np.ones(n_words, bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)  # first word of each line
    count = np.diff(np.append(first, n_words))
    begin, end = words.starts[first], words.ends[np.append(first[1:], n_words) - 1]
    kinds = _KINDS[raw]

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return (sums[end] - sums[begin]).astype(np.float64)

    upper, digits, symbols, bars, bangs, letters = (total((kinds >> b) & 1) for b in range(6))
    length = np.add.reduceat(words.ends - words.starts, first).astype(np.float64)
    same = np.zeros(n_words, bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & ~new[1:]
    # words already used in the document, and lines equal to an earlier one
    def repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keys = (owner.astype(np.uint64) << np.uint64(40)) ^ (hashes >> np.uint64(24))
        order = np.argsort(keys, kind="stable")
        out = np.zeros(len(keys), bool)
        out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        return out

    known = repeated(doc, words.hashes)
    place = np.arange(n_words) - np.repeat(first, count) + 1
    line_hash = np.add.reduceat(words.hashes * place.astype(np.uint64), first)
    again = repeated(doc[first], line_hash)
    last = raw[end - 1]
    lines = np.bincount(doc[first], minlength=len(offsets) - 1)[doc[first]]
    x = np.column_stack([
        np.log1p(end - begin), np.log1p(count), length / count / 10, upper / length, digits / length, symbols / length,
        bars / length, bangs / length, letters / length, np.add.reduceat(same.astype(np.float64), first) / count,
        np.add.reduceat(known.astype(np.float64), first) / count, np.isin(last, list(b".!?")).astype(float), again.astype(float),
        np.log1p(lines)])
    return doc[first], (end - begin).astype(np.float64), x.astype(np.float32)


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, the means over the previous and next line of the document, marks of its ends, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    joined = (doc[1:] == doc[:-1])[:, None]
    before[1:] = np.where(joined, x[:-1], 0)
    after[:-1] = np.where(joined, x[1:], 0)
    has_before, has_after = np.zeros(len(x)), np.zeros(len(x))
    has_before[1:], has_after[:-1] = joined[:, 0], joined[:, 0]
    near = (before + after) / np.maximum(has_before + has_after, 1)[:, None]
    return np.column_stack([x, near, has_before, has_after, np.ones(len(x))])


@dataclass(frozen=True)
class Layout:
    """Lines in the order of their place in a document, documents by falling size: what advances together is one
    slice.  ``order`` has the line at each position, ``starts[t]`` the position of the first line of place t,
    ``last`` the position of each document's last line."""

    order: np.ndarray
    starts: list[int]
    last: np.ndarray

    @staticmethod
    def of(doc: np.ndarray) -> Layout:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(doc)))
        place = np.arange(len(doc)) - np.repeat(first, size)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(first))
        order = np.lexsort((np.repeat(rank, size), place))
        starts = np.concatenate([[0], np.cumsum(np.bincount(place))]).astype(np.int64)
        size = np.sort(size)[::-1]
        return Layout(order, starts.tolist(), starts[size - 1] + np.arange(len(size)))


def marginals(doc: np.ndarray, emit: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None,
              layout: Layout | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected numbers of label pairs (2 x 2, each line counted ``weight`` times) and the log
    partition, by forward-backward.

    ``emit`` is the score of "good" against "bad" (0); ``pair[a, b]`` scores label b after label a.  All documents
    advance together, line by line.  Two labels need only the difference of their messages.
    """
    layout = layout or Layout.of(doc)
    order, starts, n = layout.order, layout.starts, len(doc)
    score = emit[order]
    ahead, back = score.copy(), np.zeros(n)
    (p00, p01), (p10, p11) = pair.tolist()
    for t in range(1, len(starts) - 1):
        lo, hi, before = starts[t], starts[t + 1], starts[t - 1]
        x = ahead[before:before + hi - lo]
        ahead[lo:hi] += np.logaddexp(p01, x + p11) - np.logaddexp(p00, x + p10)
    for t in range(len(starts) - 3, -1, -1):
        lo, hi = starts[t + 1], starts[t + 2]
        x = score[lo:hi] + back[lo:hi]
        back[starts[t]:starts[t] + hi - lo] = np.logaddexp(p10, x + p11) - np.logaddexp(p00, x + p01)
    good = np.empty(n)
    good[order] = np.exp(-np.logaddexp(0, -(ahead + back)))
    head = starts[1] if n else 0
    at = np.arange(head, n)  # lines with a line before them
    width = np.diff(starts)[:-1]
    prior = ahead[at - np.repeat(width, np.diff(starts)[1:])]
    logs = np.stack([np.full(len(at), p00), p01 + score[at] + back[at], p10 + prior, p11 + prior + score[at] + back[at]])
    share = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
    joint = (share.sum(axis=1) if weight is None else share @ weight[order][at]).reshape(2, 2)
    norm = np.logaddexp(p00, prior + p10).sum() + np.logaddexp(0, ahead[layout.last]).sum()
    return good, joint, float(norm)


def fit(doc: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray, cfg: LineCrf) -> dict:
    """Weights of the field by gradient ascent on the weighted conditional likelihood.

    ``label`` and ``weight`` are per line; lines of a document are neighbours.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / scale
    w, pair = np.zeros(z.shape[1]), np.zeros((2, 2))
    layout = Layout.of(doc)
    same = doc[1:] == doc[:-1]
    true = np.zeros((2, 2))
    np.add.at(true, (label[:-1][same].astype(int), label[1:][same].astype(int)), weight[1:][same])
    moments = [np.zeros_like(w), np.zeros((2, 2)), np.zeros_like(w), np.zeros((2, 2))]
    for step in range(1, cfg.steps + 1):
        p, joint, _ = marginals(doc, z @ w, pair, weight, layout)
        grad_w = z.T @ (weight * (label - p)) - cfg.l2 * len(z) * w
        grad_p = true - joint - cfg.l2 * len(z) * pair
        for i, (value, grad) in enumerate(((w, grad_w / len(z)), (pair, grad_p / len(z)))):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 2] = 0.999 * moments[i + 2] + 0.001 * grad * grad
            value += cfg.rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 2] / (1 - 0.999**step)) + 1e-8)
    return {"w": w, "pair": pair, "mean": mean, "scale": scale}


def raw_quality(model: dict, doc: np.ndarray, size: np.ndarray, x: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the length-weighted mean marginal per document, and which documents have lines."""
    out = np.zeros(n_docs)
    has = np.zeros(n_docs, bool)
    if len(doc):
        good, _, _ = marginals(doc, ((x - model["mean"]) / model["scale"]) @ model["w"], model["pair"])
        total = np.bincount(doc, size, n_docs)
        has = total > 0
        share = np.divide(np.bincount(doc, size * good, n_docs), total, out=out, where=has).clip(1e-6, 1 - 1e-6)
        out = np.log(share / (1 - share))
    return out, has


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Weighted logistic calibration by Newton steps, with a small ridge."""
    a, b = 0.1, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * a, (weight * (p - y)).sum() + 1e-3 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", cfg: LineCrf = LineCrf()) -> dict | None:
    """Model from labelled documents; ``train_rows`` is a condition on ``labels``.  None without a label.

    Of each class the ``cfg.sample`` labelled ids of ``docs`` that come first by a hash are used, which are few
    enough to broadcast; of an id's several labels the lowest counts.  Of a long document a run of
    ``cfg.sample_lines`` lines teaches, whose place depends on the id.  Without words of both classes the model
    is the share of the labels' good documents (``prior``).
    """
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(train_rows) if train_rows is not None else rows
    every = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    shares = {r.label: r["count"] for r in every.groupBy("label").count().collect()}
    if not shares.get(0) and not shares.get(1):
        return None
    prior = {"prior": shares.get(1, 0) / (shares.get(0, 0) + shares.get(1, 0))}
    one = every.join(docs.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).alias("id")), "id", "left_semi")
    totals = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return prior
    picked = [one.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(cfg.sample) for v in (0, 1)]
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "id")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    begin = F.pmod(F.xxhash64("id"), F.greatest(F.size("lines") - cfg.sample_lines + 1, F.lit(1))).cast("int") + 1
    run = F.array_join(F.slice("lines", begin, cfg.sample_lines), "\n")

    def features(batches):
        powers = Powers()
        for batch in batches:
            label = np.array(batch.column(1).to_pylist())
            for lo, _, raw, offsets in chunks(batch.column(0)):
                doc, size, x = line_features(raw, offsets, powers)
                for d in np.unique(doc):
                    at = doc == d
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(label[lo + d])], pa.int32()), pa.array([size[at].tobytes()], pa.binary()),
                         pa.array([x[at].tobytes()], pa.binary())], names=["label", "size", "x"])

    taught = F.when(F.size("lines") > cfg.sample_lines, run).otherwise(F.col("text"))
    found = (sample.withColumn("lines", lines).select(taught.alias("text"), "label")
             .mapInArrow(features, "label int, size binary, x binary").collect())
    found.sort(key=lambda r: (r.label, r.x))
    if len({r.label for r in found}) < 2:
        return prior
    sizes = [np.frombuffer(r.size) for r in found]
    doc = np.repeat(np.arange(len(found)), [len(s) for s in sizes])
    x = with_neighbours(doc, np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in found]))
    label = np.array([r.label for r in found])
    share = {v: totals[v] / max((label == v).sum(), 1) for v in (0, 1)}
    scale = len(found) / (totals[0] + totals[1])
    weight = np.array([share[v] * scale for v in label])  # the sample weighs as the labelled documents do
    model = fit(doc, x, label[doc].astype(float), weight[doc], cfg)
    z, _ = raw_quality(model, doc, np.concatenate(sizes), x, len(found))
    model["calibration"] = _logistic(z, label.astype(float), weight)
    return model


def score_quality(docs: DataFrame, model: dict | None, text_col: str = "text",
                  score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``score_col`` between 0 and 1; every row stays, nothing is shuffled.

    Null and empty texts, and texts without a word, have no line to judge and score 0.  A model
    that is only a prior gives every other text that score; without a model they are an error.
    """
    def run(batches):
        powers = Powers()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, raw, offsets in chunks(batch.column(batch.num_columns - 1)):
                doc, size, x = line_features(raw, offsets, powers)
                if model is None and len(doc):
                    raise ValueError("no labels: nothing tells how good a text is")
                if model is None or "prior" in model:
                    score[lo + np.unique(doc)] = model["prior"] if model else 0.0
                    continue
                z, has = raw_quality(model, doc, size, with_neighbours(doc, x), hi - lo)
                a, b = model["calibration"]
                score[lo:hi] = np.where(has, 1 / (1 + np.exp(-(a * z + b))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], schema=out)

    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(score_col)).schema
    out = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)
