"""Substring deduplication: every word that lies in a repeated window of ``window`` words is removed, except at the
window's earliest place.

1. Anchors.  The ``window``-word window at each place has an anchor: the leftmost of its smallest ``gram``-word
   hashes.  Equal windows have equal anchors, about one word in seven is one, and only windows with an anchor that
   occurs twice can repeat.
2. Repeated windows.  Windows with such an anchor are dealt by the words from their begin to the end of their anchor
   into groups that fit in memory, and compared by 64-bit hashes; equal ones of a task are folded first.  What repeats
   is cut into runs of consecutive begins, and equal runs are folded, so a passage that a third of all documents have
   is one run.
3. Prefix-partitioned suffix trees over the distinct runs.  Each suffix, of ``reach`` words at most, goes to the group
   of its variable-length prefix (8 to 20 words, from its begin to the end of its anchor), so every subtree is whole in
   one group.  To remove repeats, up to ``step - 1`` words at the begin of a prefix do not count, so neighbouring suffixes
   share a group and travel as one piece of text.  A group's suffixes are sorted by their words and the lengths of the common prefixes of neighbours give
   the tree: an internal node of ``window`` or more words is a repeat, and of its leaves all but the earliest begin a
   removed window.  ``maximal_repeats`` reports these nodes where no word can be added on either side.
4. The removed windows of a document are united and its other words kept.

Hashes only choose what is compared (64 bits for windows, 128 for runs); that suffixes are equal is decided by their words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .hilbert import ordered
from .words import Powers, Words, chunks, inside, mix, window_hashes, words_of

FOLDED = 400_000  # suffixes of a task, with their words, among which equal ones are folded
SCHEMA = "part int, direct boolean, a binary, b binary, doc binary, pos binary"


@dataclass(frozen=True)
class Repeats:
    """``flush``: places a task holds before it sends them on; ``group``: places of a group on average; ``reach``: words
    of a suffix in a tree; ``step``: most neighbouring suffixes that one anchor deals to one group."""

    window: int = 20
    gram: int = 8
    reach: int = 32
    flush: int = 2_000_000
    group: int = 125_000
    step: int = 7


def _windows(words: Words, cfg: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside one text, the place of each one's anchor, and the hashes of all grams."""
    at = inside(words, cfg.window)
    grams = window_hashes(words.hashes, cfg.gram)
    if not len(at):
        return at, at, grams
    span = cfg.window - cfg.gram + 1
    least = grams[at].copy()
    for d in range(1, span):
        np.minimum(least, grams[at + d], out=least)
    anchor = np.empty_like(at)
    for d in range(span - 1, -1, -1):
        hit = grams[at + d] == least
        anchor[hit] = at[hit] + d
    return at, anchor, grams


def _row(part: int, direct: bool, a, b, doc, pos) -> tuple:
    return part, direct, a.tobytes(), b.tobytes(), doc.astype(np.int64).tobytes(), pos.astype(np.int32).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["part", "direct", "a", "b", "doc", "pos"])


def _parts(part: np.ndarray, *columns: np.ndarray):
    """Slices of the columns per value of ``part``."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else [0]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[lo]), *(c[order[lo:hi]] for c in columns)


def _replies(doc: np.ndarray, pos: np.ndarray):
    """Batches of ``doc_id, pos`` (packed places), one row per document."""
    rows = [(d, p.astype(np.int32).tobytes()) for d, p in _parts(doc, pos)]
    for lo in range(0, len(rows), 20_000):
        ids, packed = zip(*rows[lo:lo + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "pos"])


def _numbers(a: bytes, b: bytes, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), doc, pos


def _pieces(reach: int):
    """A reader of packets of pieces of text, one per line: their suffixes of ``reach`` words, with documents and places."""
    def read(a: bytes, _: bytes, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(a, np.uint8)
        ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        line = np.cumsum(np.append(0, raw[ends[:-1]] == 10))
        at = np.flatnonzero(line[:len(line) - reach + 1] == line[reach - 1:])
        text = np.array([*(a[x:y] for x, y in zip(starts[at].tolist(), ends[at + reach - 1].tolist(), strict=True)), None], object)[:-1]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        return text, doc[line[at]], (pos[line[at]] + at - first[line[at]]).astype(np.int32)

    return read


def _texts(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a packet and what stands before them, one per line."""
    out = []
    for x in (a, b):
        lines = x.split(b"\n")
        column = np.empty(len(lines), object)
        column[:] = lines
        out.append(column)
    return out[0], out[1]


def _solved(sent: DataFrame, solve, cfg: Repeats, parts: int, read=_numbers) -> DataFrame:
    """Deal rows by ``part``, solve each part by itself, gather the places of each document: ``doc_id, pos``.

    Answers travel packed by buckets of documents, so their number of rows follows the input and not the number
    of parts that a document's words fall into.
    """
    def run(batches):
        part, held, docs, places, count = None, [], [], [], 0

        def answer(doc, pos):
            nonlocal count
            docs.append(doc)
            places.append(pos)
            count += len(doc)

        def done():
            if held:
                answer(*solve(*(np.concatenate(column) for column in zip(*held, strict=True))))

        def packed():
            nonlocal docs, places, count
            doc, pos = np.concatenate(docs), np.concatenate(places)
            docs, places, count = [], [], 0
            bucket = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            rows = [(b, d.tobytes(), p.astype(np.int32).tobytes()) for b, d, p in _parts(bucket, doc, pos)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "doc", "pos"])

        for batch in batches:
            for row in batch.to_pylist():
                doc, pos = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["pos"], np.int32)
                if row["direct"]:
                    answer(doc, pos)
                else:
                    if row["part"] != part:
                        done()
                        part, held = row["part"], []
                    held.append(read(row["a"], row["b"], doc, pos))
                if count >= cfg.flush:
                    yield packed()
        done()
        if count:
            yield packed()

    def gather(batches):
        bucket, held = None, []

        def done():
            if held:
                yield from _replies(*(np.concatenate([h[i] for h in held]) for i in range(2)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from done()
                    bucket, held = row["bucket"], []
                held.append((np.frombuffer(row["doc"], np.int64), np.frombuffer(row["pos"], np.int32)))
        yield from done()

    # a task has about four groups, which evens out what the hash deals
    tasks = max(8, parts // 4)
    dealt = sent.repartition(tasks, "part").sortWithinPartitions("part")
    answers = dealt.mapInArrow(run, "bucket int, doc binary, pos binary")
    return answers.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "doc_id long, pos binary")


def _repeated_anchors(docs: DataFrame, cfg: Repeats, parts: int) -> DataFrame:
    """``doc_id, pos``: packed places of the anchors that occur more than once anywhere."""
    def send(batches):
        powers, held, count = Powers(), [], 0

        def flush():
            h, doc, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = s[1:] == s[:-1]
            head = np.concatenate([[True], ~same])
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            twice = order[many]
            # settled here; others only need to know that it exists (b = 1)
            rows = [_row(int(s[0] % np.uint64(parts)), True, h[:0], h[:0].astype(np.uint32), doc[twice], pos[twice])] if len(twice) else []
            first = np.sort(order[head])
            flag = np.zeros(len(h), np.uint32)
            flag[order[many]] = 1
            rows += [_row(p, False, *x) for p, *x in _parts((h[first] % np.uint64(parts)).astype(np.int32), h[first], flag[first], doc[first], pos[first])]
            return _batch(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, offsets in chunks(batch.column(1)):
                words = words_of(raw, offsets, powers)
                _, anchor, grams = _windows(words, cfg)
                if not len(anchor):
                    continue
                anchor = np.unique(anchor)
                doc = words.doc_of()[anchor]
                held.append((grams[anchor], ids[lo + doc], anchor - words.first[doc]))
                count += len(anchor)
                if count >= cfg.flush:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def solve(h, flag, doc, pos):
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found = order[many]
        found = found[flag[found] == 0]
        return doc[found], pos[found]

    return _solved(docs.select("doc_id", "text").mapInArrow(send, SCHEMA), solve, cfg, parts)


def _places(packed: bytes | None, first: int = 0) -> np.ndarray:
    """Unpacked places of a document, as indexes from ``first``."""
    return first + np.frombuffer(packed or b"", np.int32)


def _repeated_windows(docs: DataFrame, cfg: Repeats, parts: int) -> DataFrame:
    """``doc_id, pos``: packed begins of all windows that occur more than once; ``docs`` has ``anchors``."""
    depth = cfg.window

    def send(batches):
        powers, held, count = Powers(), [], 0

        def flush():
            prefix, node, doc, pos = (np.concatenate([x[i] for x in held]) for i in range(4))
            order = np.lexsort((pos, doc, node))
            n = node[order]
            head = np.concatenate([[True], n[1:] != n[:-1]])
            later = order[~head]
            first = order[head]
            twice = np.zeros(len(n), bool)
            twice[first] = np.diff(np.append(np.flatnonzero(head), len(n))) > 1
            first = first[np.lexsort((pos[first], doc[first]))]
            part = (prefix[first] % np.uint64(parts)).astype(np.int32)
            rows = [_row(int(part[0]), True, prefix[:0], prefix[:0].astype(np.uint32), doc[later], pos[later])] if len(later) else []
            # the lowest bit tells that the window occurs twice in this task
            low = (prefix[first] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | twice[first].astype(np.uint32)
            rows += [_row(p, False, *x) for p, *x in _parts(part, node[first], low, doc[first], pos[first])]
            return _batch(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                words = words_of(raw, offsets, powers)
                at, anchor, _ = _windows(words, cfg)
                if not len(at):
                    continue
                again = np.zeros(len(words.starts) + 1, bool)
                for d in range(hi - lo):
                    again[_places(lists[lo + d].as_py(), words.first[d])] = True
                mine = again[anchor]
                at, anchor = at[mine], anchor[mine]
                if not len(at):
                    continue
                up, down = powers.upto(len(words.starts) + 1)
                sums = np.zeros(len(words.starts) + 1, np.uint64)
                np.cumsum(words.hashes * up[:-1], out=sums[1:])
                node = mix((sums[at + depth] - sums[at]) * down[at] + np.uint64(depth))
                end = anchor + cfg.gram
                prefix = mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64))
                doc = words.doc_of()[at]
                held.append((prefix, node, ids[lo + doc], at - words.first[doc]))
                count += len(at)
                if count >= cfg.flush:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def solve(node, low, doc, pos):
        prefix, twice = low >> np.uint32(1), (low & np.uint32(1)).astype(bool)
        order = np.lexsort((prefix, node))
        same = (node[order][1:] == node[order][:-1]) & (prefix[order][1:] == prefix[order][:-1])
        many = np.append(False, same) | np.append(same, False) | twice[order] if len(order) else np.zeros(0, bool)
        found = order[many]
        return doc[found], pos[found]

    return _solved(docs.select("doc_id", "text", "anchors").mapInArrow(send, SCHEMA), solve, cfg, parts)


RUNS = "doc_id long, first int, n int, key binary, text binary"


def _runs(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """``RUNS``: runs of ``n`` consecutive begins of repeated windows, with the MD5 of their words and, for the first of
    equal runs of a task, the words; ``docs`` has ``places``."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for doc, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, at = text.encode().split(), np.unique(_places(packed))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                for part in np.split(at, cuts):
                    body = b" ".join(words[part[0]:part[-1] + cfg.window])
                    key = hashlib.md5(body).digest()
                    # the word before a run tells whether its repeats can be extended to the left
                    before = words[part[0] - 1] if part[0] else b""
                    new = key not in seen
                    if new:
                        seen.add(key)
                    rows.append((doc, int(part[0]), len(part), key, before + b"\n" + body if new else None))
            if len(seen) > 500_000:  # a memory bound; forgotten runs only send their words again
                seen.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)],
                                             names=["doc_id", "first", "n", "key", "text"])

    return docs.select("doc_id", "text", "places").mapInArrow(run, RUNS)


def _neighbours(distinct: DataFrame, cfg: Repeats) -> DataFrame:
    """``distinct`` runs in ranges of their smallest gram hash, so that near copies of a run mostly lie in one task; ties are
    ordered by key, so a large group is cut and is no task of its own."""
    def run(batches):
        powers = Powers()
        for batch in batches:
            least = np.zeros(batch.num_rows, np.int64)
            for lo, hi, raw, offsets in chunks(batch.column(3).cast(pa.string())):
                words = words_of(raw, offsets, powers)
                grams = window_hashes(words.hashes, cfg.gram)
                at = inside(words, cfg.gram)
                doc = words.doc_of()[at]
                if len(at):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    least[lo + doc[first]] = np.minimum.reduceat(grams[at], first).view(np.int64)
            yield batch.append_column("least", pa.array(least))

    schema = T.StructType([*distinct.schema.fields, T.StructField("least", T.LongType())])
    return distinct.mapInArrow(run, schema).repartitionByRange("least", "key").drop("least")


def _suffixes(runs: DataFrame, cfg: Repeats, parts: int, fold: bool = False) -> DataFrame:
    """Suffixes of the distinct ``runs (doc_id, first, text, copies)``, dealt by their prefixes (``SCHEMA``); ``b`` has the
    copies of the run and the word before the suffix.  ``fold`` keeps one of the equal suffixes that a task holds, the
    earliest, answers for the others at once, sends neighbours of a group as one piece of text with the place of its first
    suffix (``_pieces``) and leaves ``b`` empty; suffixes then have exactly ``reach = window`` words."""
    step = cfg.step if fold else 1

    def folded(held: list[tuple]) -> pa.RecordBatch:
        prefix, text, doc, pos, begin, end, chunk = (np.concatenate([x[i] for x in held]) for i in range(7))
        bodies = [x[7] for x in held]
        seen: set[bytes] = set()
        order = np.lexsort((pos, doc))
        new = np.array([not (t in seen or seen.add(t)) for t in text[order].tolist()], bool)
        first, later = order[new], order[~new]
        part = (prefix[first] % np.uint64(parts)).astype(np.int32)
        rows = [(int(part[0]), True, b"", b"", doc[later].tobytes(), pos[later].astype(np.int32).tobytes())] if len(later) else []
        # first is in order of place; a run's begins are in one chunk, and between two runs of a document lies another begin
        apart = (part[1:] != part[:-1]) | (doc[first][1:] != doc[first][:-1]) | (np.diff(pos[first]) != 1)
        head, tail = first[np.append(True, apart)], first[np.append(apart, True)]
        pieces = np.array([*(bodies[c][x:y] for c, x, y in zip(chunk[head].tolist(), begin[head].tolist(), end[tail].tolist(), strict=True)), None], object)[:-1]
        rows += [(p, False, b"\n".join(a.tolist()), b"", d.tobytes(), q.astype(np.int32).tobytes())
                 for p, a, d, q in _parts(part[np.append(True, apart)], pieces, doc[head], pos[head])]
        return _batch(rows)

    def send(batches):
        powers, held, count = Powers(), [], 0
        for batch in batches:
            ids, first = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            packed = [t.split(b"\n", 1) for t in batch.column(2).to_pylist()]
            copies = batch.column(3).to_pylist()
            for lo, _, raw, offsets in chunks(pa.array([t[1] for t in packed], pa.binary()).cast(pa.string())):
                words = words_of(raw, offsets, powers)
                at, anchor, _ = _windows(words, cfg)
                if not len(at):
                    continue
                up, down = powers.upto(len(words.starts) + 1)
                sums = np.zeros(len(words.starts) + 1, np.uint64)
                np.cumsum(words.hashes * up[:-1], out=sums[1:])
                end, begin = anchor + cfg.gram, at + (anchor - at) % step
                prefix = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
                doc = words.doc_of()[at]
                pos = at - words.first[doc]
                last = np.minimum(at + cfg.reach, words.first[doc + 1]) - 1
                body = raw.tobytes()
                text = [body[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[last].tolist(), strict=True)]
                if fold:
                    held.append((prefix, np.array([*text, None], object)[:-1], ids[lo + doc].astype(np.int64), first[lo + doc] + pos,
                                 words.starts[at], words.ends[last], np.full(len(at), len(held)), body))
                    count += len(at)
                    if count >= FOLDED:
                        yield folded(held)
                        held, count = [], 0
                    continue
                # copies of a run differ in the word before it, or it would be longer
                left = [b"%d %s" % (copies[lo + d], body[a:b] if p else packed[lo + d][0] if copies[lo + d] == 1 else b"") for p, d, a, b in zip(
                    pos.tolist(), doc.tolist(), words.starts[np.maximum(at - 1, 0)].tolist(), words.ends[np.maximum(at - 1, 0)].tolist(), strict=True)]
                text, left = (np.array([*x, None], object)[:-1] for x in (text, left))
                rows = [(p, False, b"\n".join(a.tolist()), b"\n".join(b.tolist()), d.astype(np.int64).tobytes(), q.astype(np.int32).tobytes())
                        for p, a, b, d, q in _parts((prefix % np.uint64(parts)).astype(np.int32), text, left, ids[lo + doc], first[lo + doc] + pos)]
                yield _batch(rows)
        if held:
            yield folded(held)

    return runs.select("doc_id", "first", "text", "copies").mapInArrow(send, SCHEMA)


def common_words(a: bytes, b: bytes) -> int:
    """Number of leading words that two texts (words joined by a blank) have in common."""
    if a == b:
        return a.count(b" ") + 1
    n = min(len(a), len(b))
    lo, hi = 0, n  # longest common prefix in bytes, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    whole = (lo == len(a) or a[lo:lo + 1] == b" ") and (lo == len(b) or b[lo:lo + 1] == b" ")
    return a[:lo].count(b" ") + (1 if whole and lo else 0)


def deep_nodes(texts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their tree, the words that each shares with the one before, and the number of the
    node of ``depth`` that it belongs to (a node of one suffix is a leaf)."""
    # a blank sorts before the characters of words, so a text stands before its extensions; control characters do not
    plain = not len(texts) or np.frombuffer(b"".join(texts), np.uint8).min(initial=255) >= 32
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__ if plain else lambda i: texts[i].split(b" ")), np.int64)
    shared = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        shared[i] = common_words(texts[order[i - 1]], texts[order[i]])
    return order, shared, np.cumsum(shared < depth)


def _tree_answers(suffixes: DataFrame, cfg: Repeats, parts: int) -> DataFrame:
    """``doc_id, pos``: packed begins of the suffixes below a node of ``window`` words that are not its earliest leaf."""
    def solve(texts, doc, pos):
        order, _, node = deep_nodes(texts, cfg.window)
        by = np.lexsort((pos[order], doc[order], node))
        later = order[by[np.append(False, node[by][1:] == node[by][:-1])]] if len(by) else order
        return doc[later], pos[later]

    return _solved(suffixes, solve, cfg, parts, _pieces(cfg.reach))


REPEATS = "words string, n_words int, places long, doc_id long, pos int, cut boolean"


def inner_nodes(shared: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """``(words, first, last)`` of the internal nodes of ``depth`` or more: ranges of suffixes, from common prefixes."""
    out, stack = [], [(0, 0)]  # (words, first suffix)
    for i in range(1, len(shared) + 1):
        now = int(shared[i]) if i < len(shared) else 0
        first = i - 1
        while stack[-1][0] > now:
            words, first = stack.pop()
            if words >= depth:
                out.append((words, first, i - 1))
        if stack[-1][0] < now:
            stack.append((now, first))
    return out


def _nodes(suffixes: DataFrame, cfg: Repeats, parts: int) -> DataFrame:
    """``REPEATS`` of every group: its internal nodes whose places differ in the word before."""
    def run(batches):
        part, held = None, []

        def found():
            texts, left, doc, pos = (np.concatenate([h[i] for h in held]) for i in range(4))
            copies = np.array([int(x.split(b" ", 1)[0]) for x in left], np.int64)
            before = np.array([x.split(b" ", 1)[1] for x in left] + [None], object)[:-1]
            order, shared, _ = deep_nodes(texts, cfg.window)
            rows = []
            for words, lo, hi in inner_nodes(shared, cfg.window):
                leaves = order[lo:hi + 1]
                words_before = set(before[leaves].tolist())
                if len(words_before) > 1 or b"" in words_before:
                    head = leaves[np.lexsort((pos[leaves], doc[leaves]))[0]]
                    text = b" ".join(texts[head].split(b" ")[:words]).decode()
                    rows.append((text, words, int(copies[leaves].sum()), int(doc[head]), int(pos[head]), words == cfg.reach))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)],
                                              names=["words", "n_words", "places", "doc_id", "pos", "cut"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield found()
                    part, held = row["part"], []
                held.append((*_texts(row["a"], row["b"]), np.frombuffer(row["doc"], np.int64), np.frombuffer(row["pos"], np.int32)))
        if held:
            yield found()

    return suffixes.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, REPEATS)


def _kept(docs: DataFrame, cfg: Repeats, with_text: bool) -> DataFrame:
    """Counts, digest and, if asked for, text of what is kept; ``docs`` has ``starts`` (null: nothing removed)."""
    size = cfg.window

    def run(batches):
        for batch in batches:
            n_words, removed, digest, kept = [], [], [], []
            for text, lists in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at the same six white-space bytes
                n, lists = len(words), lists.as_py()
                if lists:
                    edge = np.zeros(n + 1, np.int32)
                    for at in map(_places, lists["pos"]):
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + size, -1)
                    for run in lists["runs"]:
                        edge[run["first"]] += 1
                        edge[run["first"] + run["n"] - 1 + size] -= 1
                    words = list(compress(words, np.cumsum(edge[:n]) == 0))
                line = b" ".join(words)
                n_words.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(line).hexdigest())
                kept.append(line.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _distinct_runs(rows: DataFrame, wanted: DataFrame, cfg: Repeats, parts: int) -> tuple[DataFrame, DataFrame]:
    """All runs, and of equal ones the first in order of (document, place) with its words."""
    places = materialize(_repeated_windows(wanted, cfg, parts), "places").select(F.col("doc_id").alias("_id"), F.col("pos").alias("places"))
    runs = materialize(_runs(rows.join(places, rows.doc_id == F.col("_id")).drop("_id"), cfg), "runs")
    distinct = runs.groupBy("key").agg(F.min(F.struct("doc_id", "first")).alias("place"), F.first("text", True).alias("text"), F.count("*").alias("copies"))
    return runs, materialize(_neighbours(distinct.select("key", "place.*", "text", "copies"), cfg), "distinct")


def _numbered(docs: DataFrame, id_col: str, text_col: str, cfg: Repeats) -> tuple[DataFrame, DataFrame | None, int]:
    """``(doc_id, text)`` with ids that tell rows apart, the given ids if they did not, and the number of groups."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, ids = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    numbered = None
    if ids < n:
        keyed = rows.select(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("given"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "text")
        numbered = materialize(ordered(keyed, ["last", "given", "hash"], "doc_id").select("doc_id", "given", "text"), "numbered")
        rows = numbered.select("doc_id", "text")
    words = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).first().bytes or 0
    return rows, numbered, max(8, int(words // 6 // 7 // cfg.group) * 2)  # about 6 bytes a word, one anchor in 7 words


def _with_anchors(rows: DataFrame, cfg: Repeats, parts: int) -> DataFrame:
    anchors = materialize(_repeated_anchors(rows, cfg, parts), "anchors").select(F.col("doc_id").alias("_id"), F.col("pos").alias("anchors"))
    return rows.join(anchors, rows.doc_id == F.col("_id")).drop("_id")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Repeats = Repeats()) -> DataFrame:
    """``words, n_words, places, doc_id, pos, cut``: word sequences of ``cfg.window`` words or more that occur ``places``
    times (2 at least) and cannot be extended by one word at all of them on either side, with their earliest place.

    They are the internal nodes of the trees whose places differ in the word before, and the runs that occur as a whole
    more than once.  Trees know ``cfg.reach`` words of a suffix; a longer common part inside of runs is reported with its
    first ``reach`` words and ``cut``.  If ids repeat or are null, rows are numbered by (id, nulls last, text) and
    ``doc_id`` is that number.  Null texts have no words; an empty table gives an empty table.
    """
    rows, _, parts = _numbered(docs, id_col, text_col, cfg)
    _, distinct = _distinct_runs(rows, _with_anchors(rows, cfg, parts), cfg, parts)
    body = F.element_at(F.split(F.decode("text", "UTF-8"), "\n"), 2)
    whole = distinct.filter("copies > 1").select(body.alias("words"), F.size(F.split(body, " ")).alias("n_words"), F.col("copies").alias("places"),
                                                 "doc_id", F.col("first").alias("pos"), F.lit(False).alias("cut"))
    found = _nodes(_suffixes(distinct, cfg, parts), cfg, parts).unionByName(whole)
    best = found.groupBy("words").agg(F.first("n_words").alias("n_words"), F.max("places").alias("places"), F.min(F.struct("doc_id", "pos")).alias("at"),
                                      F.min("cut").alias("cut"))
    return best.select("words", "n_words", "places", F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"), "cut")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Repeats = Repeats(),
                   with_text: bool = True) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256, kept_text`` for every row.

    Earlier means a smaller id, or the same document and an earlier place.  Windows are judged on the input.
    Null texts have no words.  If ids repeat or are null, rows are first numbered by (id, nulls last, text), so of
    equal rows one is the earliest.  Texts shorter than a window keep all words.  An empty table stays empty.
    """
    rows, numbered, parts = _numbered(docs, id_col, text_col, cfg)
    wanted = _with_anchors(rows, cfg, parts)
    runs, distinct = _distinct_runs(rows, wanted, cfg, parts)
    only = replace(cfg, reach=cfg.window)  # what lies deeper removes nothing more
    trees = _tree_answers(_suffixes(distinct, only, parts, fold=True), only, parts)
    # every begin of a run that is not the first one of its words is removed
    heads = distinct.select(F.col("key").alias("of"), F.col("doc_id").alias("doc"), F.col("first").alias("at"))
    copies = runs.join(heads, (F.col("key") == F.col("of")) & ((F.col("doc_id") != F.col("doc")) | (F.col("first") != F.col("at")))).select("doc_id", "first", "n")
    found = trees.select("doc_id", "pos", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("n")).unionByName(
        copies.withColumn("pos", F.lit(None).cast("binary")))
    starts = materialize(found.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list(F.when(
        F.col("n").isNotNull(), F.struct("first", "n"))).alias("runs")), "starts").select(F.col("doc_id").alias("_id"), F.struct("pos", "runs").alias("starts"))
    out = _kept(rows.join(starts, rows.doc_id == F.col("_id"), "left").drop("_id"), cfg, with_text)
    if numbered is not None:
        given = numbered.select(F.col("doc_id").alias("_id"), "given")
        out = out.join(given, out.doc_id == F.col("_id")).drop("doc_id", "_id").withColumnRenamed("given", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
