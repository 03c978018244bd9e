"""The training-data operators against brute force, on small tables and on odd rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfd.llm import queries as Q
from nearfd.llm.components import components
from nearfd.llm.decontam import contamination
from nearfd.llm.hilbert import hilbert_index, hilbert_shards
from nearfd.llm.htmltext import extract_pages, main_text
from nearfd.llm.linecrf import LineCrf, marginals, score_quality, train
from nearfd.llm.mixing import mix_sources
from nearfd.llm.neardup import NearDup, near_duplicates, without_near_duplicates
from nearfd.llm.rules import judged, learn_rules, text_stats
from nearfd.llm.separators import file_blocks, scan, token_counts
from nearfd.llm.suffixes import Repeats, maximal_repeats, remove_repeats
from nearfd.llm.urls import judge_urls

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000
#: null and empty texts, white space only, one word, repeated rows, null and repeated ids, a very long text
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"),
       (5, "another text with the same id as before"), (6, LONG), (7, LONG), (8, "é ü ñ 漢字 😀 " * 5)]


def words(text):
    return SPLIT.findall(text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, row int, epochs string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


# ------------------------------------------------------------------ op1

bytewise = lambda: lambda text: list(text.encode())  # noqa: E731 - a lambda travels to the tasks by value


def test_scan_finds_documents_across_blocks(spark, odd, empty, docs, data):
    got = token_counts(odd.filter("length(text) < 100 OR text IS NULL"), bytewise, 999, block_bytes=16).collect()
    want = [(i, len((t or "").encode())) for i, t in ODD if len(t or "") < 100]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(empty, bytewise, 999).count() == 0
    full = token_counts(spark.read.parquet(f"{data}/documents.parquet"), bytewise, 999, block_bytes=4096)
    assert {r.doc_id: r.n_tokens for r in full.collect()} == {i: len(t.encode()) for i, t in docs.items()}


def test_scan_of_flat_files(spark, tmp_path):
    np.array([7, 7, 9, 9, 7, 7, 7], "uint16").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = scan(file_blocks(spark, str(tmp_path), 4), 9).select("ordinal", "start", "n_tokens", "closed").orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_op1_equals_the_tokenizer(spark, data, docs):
    encode = Q.public_tokenizer()()
    got = {r.doc_id: r.n_tokens for r in Q.op1_separator_scan(spark, data).collect()}
    assert got == {i: len(encode(t)) for i, t in docs.items()}


# ------------------------------------------------------------------ op2

def brute_stats(text):
    w = words(text)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_stats(odd, empty):
    got = text_stats(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *brute_stats(t)) for i, t in ODD)
    assert text_stats(empty).count() == 0


def test_rules_are_learned(spark, odd, empty):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("bad", F.when((F.col("a") > 0.65) & (F.col("b") <= 2), 1).otherwise(0))
    rules = learn_rules(rows, features=["a", "b"])
    assert rules and all(r.precision >= 0.7 for r in rules)
    hit = F.lit(False)
    for r in rules:
        hit = hit | r.column()
    assert rows.filter(hit != (F.col("bad") == 1)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = {(r.doc_id, r.kept) for r in judged(odd, labels).collect()}
    assert (6, False) in kept and (4, False) in kept and judged(empty, labels).count() == 0


def test_op2_judges_by_labels(spark, data, docs):
    got = Q.op2_decision_lists(spark, data).collect()
    assert {tuple(r)[:6] for r in got} == {(i, *brute_stats(t)) for i, t in docs.items()}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


# ------------------------------------------------------------------ op3

def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates(spark, odd, empty):
    base = [f"w{i}" for i in range(300)]
    near = list(base)
    near[100] = "other"
    far = base[:150] + [f"z{i}" for i in range(150)]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(far)), (13, " ".join(base)), (14, " ".join(f"q{i}" for i in range(50)))]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 10, 14: 14}
    out = near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {(r.doc_id, r.class_id) for r in out} >= {(1, 1), (2, 1), (None, 5), (6, 6), (7, 6), (3, 3)}
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 5, 6, 8]
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [2048, 4])
def test_near_duplicates_of_a_large_group(spark, cell):
    """Copies that share most shingles with the base, in whole and in split cells, against exact similarities."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(200)], []
    for d in range(60):
        text = list(base)
        for at in rng.integers(0, 200, 5):
            text[at] = f"n{d}-{at}"
        rows.append((d, " ".join(text)))
    rows += [(100 + d, " ".join(f"x{d}-{i}" for i in range(80))) for d in range(20)]
    cfg = NearDup(cell=cell, texts=cell)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg=cfg).collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.85:
                assert got[i] == got[j]
    assert all(got[100 + d] == 100 + d for d in range(20))


def brute_classes(texts, cfg=NearDup()):
    """Components of the pairs whose weighted Jaccard similarity reaches the threshold, with exact frequencies; a
    margin of one in a million is left to the single precision of the weights."""
    bags = {}
    for i, t in texts.items():
        w = words(t)
        bags[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    df, n = Counter(x for b in bags.values() for x in b), len(texts)
    idf = lambda x: 1 + cfg.idf_share * math.log(min(n / df[x], 1 / cfg.frequent)) / -math.log(cfg.frequent)
    weight = {i: {x: (1 + math.log(c)) * idf(x) for x, c in b.items()} for i, b in bags.items()}
    total, where, common = {i: sum(w.values()) for i, w in weight.items()}, defaultdict(list), defaultdict(float)
    for i, w in weight.items():
        for x in w:
            where[x].append(i)
    for x, ids in where.items():
        for k, i in enumerate(ids):
            for j in ids[k + 1:]:
                common[i, j] += min(weight[i][x], weight[j][x])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), c in common.items():
        if c >= (cfg.threshold - 1e-6) * (total[i] + total[j] - c):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def test_op3_equals_exact_classes(spark, data, docs):
    """Neither a lost link nor a false one, by weighted similarity at the threshold."""
    got = {r.doc_id: r.class_id for r in Q.op3_weighted_minhash(spark, data).collect()}
    want = brute_classes({i: t or "" for i, t in docs.items()})
    empty_ = [i for i, t in docs.items() if not words(t)]
    assert {i: c for i, c in got.items() if i not in empty_} == {i: c for i, c in want.items() if i not in empty_}


def test_unrelated_texts_do_not_link(spark):
    """40 texts of 96 common and 14 own words stay 40 classes, however many other texts there are: without idf their
    similarity is 0.77, and other texts can only bring the weights nearer to that."""
    common = [f"c{i}" for i in range(96)]
    rows = [(d, " ".join(common + [f"o{d}-{i}" for i in range(14)])) for d in range(40)]
    others = [(1000 + d, " ".join(f"u{d}-{i}" for i in range(60))) for d in range(3000)]
    for table in (rows, rows + others):
        got = near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).filter("doc_id < 1000").collect()
        assert len({r.class_id for r in got}) == 40


@pytest.mark.parametrize("tasks", [1, 5])
def test_frequencies_are_exact_over_slices(spark, monkeypatch, tasks):
    import nearfd.llm.neardup as N

    rng, cfg = random.Random(2), NearDup(frequent=0.05)
    texts = [" ".join(rng.choice("aaab") for _ in range(rng.randint(6, 12))) for _ in range(700)] + ["z y x w v u"] * 30 + [None, "", "one"]
    df = Counter(x for t in texts for w in [words(t)] for x in ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ()))
    want = sorted(n for n in df.values() if n >= 0.05 * len(texts))
    for size in (4_000_000, 300):
        monkeypatch.setattr(N, "SLICE_PAIRS", size)
        ids, n, total = N.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(tasks), "text", cfg)
        assert total == len(texts) and sorted(n.tolist()) == want and len(want) > 5
    assert N.frequent_shingles(spark.createDataFrame([], "text string"), "text", cfg)[2] == 0


def test_members_of_a_cell_are_rows(spark):
    import nearfd.llm.neardup as neardup

    table = spark.range(300).select((F.col("id") % 2).alias("band"), F.lit(150).alias("n"), F.encode(F.col("id").cast("string"), "UTF-8").alias("key"),
                                    F.encode((F.col("id") % 7).cast("string"), "UTF-8").alias("cls"))
    cells = neardup._cells(table, "band", "n", 50, "key", "cls")
    assert cells.columns == ["band", "p", "q", "key", "cls"] and cells.count() == 300 * 3  # no cell is one row
    got = cells.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(m)]), pa.array([len({x[0] for x in m})])], names=["n", "keys"])
                                            for m in neardup._by_cell(batches)), "n long, keys long").collect()
    assert len(got) == 2 * 6 and sum(r.n for r in got) == 900 and all(r.n == r.keys for r in got)


def test_tasks_give_memory_back_at_their_end(monkeypatch):
    import nearfd.llm.neardup as neardup

    done = []
    monkeypatch.setattr(neardup.gc, "collect", lambda: done.append(1))
    rows = neardup._released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not done
    assert list(rows) == [3] and done


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_slices_are_counted_in_place(spark, share):
    import tracemalloc

    import nearfd.llm.neardup as neardup

    rng = np.random.default_rng(3)
    every = rng.zipf(1.3, 200_000).astype(np.uint64) & neardup.ID_MASK
    ids, n = np.unique(every, return_counts=True)
    least = max(1, int(2000 * share / 4))
    held = [x.copy() for x in np.array_split(every, 7)]
    tracemalloc.start()
    got, times = neardup._counted(held, least)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == ids[n >= least].tolist() and times.tolist() == n[n >= least].tolist() and not held
    assert peak < 2.5 * every.nbytes


def test_hot_bands_and_other_ids(spark, monkeypatch):
    import nearfd.llm.neardup as N

    monkeypatch.setattr(N, "HOT_BAND", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(f"id{d:03}", " ".join([*base, f"n{d}"])) for d in range(40)] + [("zz", " ".join(f"q{i}" for i in range(50))), (None, "a b c d e f")]
    table = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("_id", "_key", "row", "key", "of")})
    got = {r.doc_id: r.class_id for r in near_duplicates(table).collect()}
    assert got == {**{f"id{d:03}": "id000" for d in range(40)}, "zz": "zz", None: None}
    kept = without_near_duplicates(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {"id000", "zz", None}


# ------------------------------------------------------------------ op4

def test_contamination(spark, odd, empty):
    item = [f"b{i}" for i in range(40)]
    changed = list(item)
    changed[1] = "new"
    half = item[:20]
    rows = [(1, " ".join(["x"] * 7 + item + ["y"] * 9)), (2, " ".join(changed)), (3, " ".join(["z"] * 30 + half)), (4, " ".join(item).upper()), (5, None)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short an"), (3, None), (None, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1)} and got[1, 1] == (1.0, 7) and got[2, 1][0] > 0.8
    assert contamination(odd, bench).count() == 0 and contamination(empty, bench).count() == 0
    assert contamination(odd, bench.limit(0)).count() == 0


def test_op4_finds_passages(spark, data, docs):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    truth = {(i, b.item_id) for i, t in docs.items() for b in bench if b.text in t}
    got = {(r.doc_id, r.item_id): r.similarity for r in Q.op4_simhash_windows(spark, data).collect()}
    assert truth <= set(got) and min(got.values(), default=1) >= 0.8


def brute_contamination(docs, items, threshold=0.8):
    """All windows of all starts; {(doc, item): (similarity, starts that reach it)}."""
    def hashed(text):
        w = words(text.lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    of = {i: hashed(t) for i, t in items if t and i is not None and len(words(t)) >= 5}
    df = Counter(h for i, hs in of.items() for h in set(hs))
    weight = lambda h: round((1 + max(math.log((1 + len(of)) / (1 + df[h])), 0) / math.log(1 + len(of))) * 1e9) if h in df else 2 * 10**9
    out = {}
    for d, text in docs:
        mine = hashed(text or "")
        everything = set(mine)
        for i, hs in of.items():
            item = set(hs)
            total = sum(map(weight, item))
            if sum(map(weight, item & everything)) < threshold * total - 1:
                continue
            for start in range(max(len(mine) - len(hs), 0) + 1):
                window = set(mine[start:start + len(hs)])
                common = sum(map(weight, window & item))
                sim = round(common / (total + sum(map(weight, window)) - common), 9)
                if sim >= threshold - 1e-9:
                    best, starts = out.get((d, i), (0, []))
                    out[d, i] = (sim, [start]) if sim > best else (best, starts + [start] * (sim == best))
    return out


def same_as_brute(found, want):
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == {k: s for k, (s, _) in want.items()}
    assert all(r.start in want[r.doc_id, r.item_id][1] for r in found)


def test_op4_equals_brute_force(spark, data, docs):
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    same_as_brute(Q.op4_simhash_windows(spark, data).collect(), brute_contamination(docs.items(), bench))


def test_windows_that_begin_before_the_item(spark):
    """A light or repeated leading shingle makes another window than that of the first known shingle the best one."""
    a = [f"a{i}" for i in range(12)]
    items = [(0, " ".join(a))] + [(i, " ".join(["x", *a[:4]] + [f"i{i}w{j}" for j in range(15)])) for i in range(1, 51)]
    items += [(60, " ".join(["r"] * 9 + [f"q{j}" for j in range(30)])), (61, " ".join(f"s{j % 7}" for j in range(40)))]
    docs = [(1, " ".join(["x", *a[:11], "y"])), (2, " ".join(["r"] * 30 + [f"q{j}" for j in range(28)] + ["z"] * 9)),
            (3, " ".join(["s6", "s5"] + [f"s{j % 7}" for j in range(200)])), (4, " ".join(a[:11])), (5, "u v w " * 40)]
    want = brute_contamination(docs, items)
    assert want[1, 0][0] > 0.8 and {1, 2, 3} <= {d for d, _ in want}
    bench = spark.createDataFrame(items, "item_id long, text string")
    same_as_brute(contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect(), want)


def test_changed_passages_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 60, 80])))) for i in range(40)]
    docs = []
    for d in range(400):
        w = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        docs.append((f"d{d}", " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + w + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))])))
    want = brute_contamination(docs, items)
    assert len(want) > 100 and min(s for s, _ in want.values()) < 0.85
    table = spark.createDataFrame(docs, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("doc", "th", "n", "item", "start", "_doc")})
    got = contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    missed = set(want) - {(r.doc_id, r.item_id) for r in got}
    assert len(missed) <= len(want) // 100  # fingerprints farther apart than the radius
    same_as_brute(got, {k: v for k, v in want.items() if k not in missed})


def test_the_index_prunes(spark):
    """Random windows of the size of random items: few pairs share a block, fewer lie within the radius."""
    import nearfd.llm.decontam as D

    rng = random.Random(1)
    sets = [(i, [(rng.getrandbits(63), 10**9) for _ in range(40)]) for i in range(600)]
    prints = spark.createDataFrame(sets, "id int, set array<struct<h:long,w:long>>").withColumn("fp", D.simhash("set"))
    keyed = lambda rows, flips, name: rows.select(F.col("id").alias(name), F.explode(D._blocks("fp", flips)).alias("b"))
    met = keyed(prints.filter("id < 200"), 1, "a").join(keyed(prints.filter("id >= 200"), 2, "c"), "b").select("a", "c").distinct().count()
    assert met < 0.12 * 200 * 400


# ------------------------------------------------------------------ op5

def brute_repeats(rows, size=20):
    seen, out = set(), []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if key in seen:
                gone[k:k + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("flush", [2_000_000, 500])
def test_op5_equals_brute_force(spark, data, docs, flush, monkeypatch):
    import nearfd.llm.suffixes as suffixes

    monkeypatch.setattr(suffixes, "FOLDED", min(flush, suffixes.FOLDED))
    got = remove_repeats(spark.read.parquet(f"{data}/documents.parquet"), cfg=Repeats(flush=flush)).drop("kept_text").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_repeats(sorted(docs.items())))


def test_op5_odd_rows(odd, empty):
    rows = sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    got = remove_repeats(odd).drop("kept_text").collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(rows))
    assert remove_repeats(empty).count() == 0


def brute_maximal(texts, least):
    """Word sequences that occur twice and differ in the words before and behind; with places."""
    where = defaultdict(list)
    for d, t in texts:
        w = words(t)
        for i in range(len(w)):
            for j in range(i + least, len(w) + 1):
                where[" ".join(w[i:j])].append((d, i, w[i - 1] if i else None, w[j] if j < len(w) else None))
    ends = lambda xs: len(set(xs)) > 1 or None in xs
    return {k: (len(v), v[0][0], v[0][1]) for k, v in where.items() if len(v) > 1 and ends([x[2] for x in v]) and ends([x[3] for x in v])}


def test_neighbouring_suffixes_travel_as_one_text(spark):
    import nearfd.llm.suffixes as suffixes

    rng = random.Random(5)
    runs = [(d, 3, ("\n" + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300))).encode(), 2) for d in range(20)]
    sent = suffixes._suffixes(spark.createDataFrame(runs, "doc_id long, first int, text binary, copies long"), Repeats(reach=20), 8, fold=True).collect()
    read = suffixes._pieces(20)
    got = Counter()
    for r in sent:
        got.update(zip(*map(list, read(bytes(r.a), b"", np.frombuffer(r.doc, np.int64), np.frombuffer(r.pos, np.int32))), strict=True))
    words_ = {d: t[1:].split() for d, _, t, _ in runs}
    assert got == Counter((b" ".join(w[k:k + 20]), d, 3 + k) for d, w in words_.items() for k in range(281))
    assert sum(len(r.a) for r in sent) < sum(len(x[0]) for x in got) / 2.5
    # the begin of a window decides its group by nothing that lies before the window
    cut = [(d, 3 + c, t[:1] + b" ".join(t.split()[c:]), n) for c, (d, _, t, n) in enumerate(runs)]
    again = suffixes._suffixes(spark.createDataFrame(cut, "doc_id long, first int, text binary, copies long"), Repeats(reach=20), 8, fold=True).collect()
    place = lambda rows: {(r.part, x) for r in rows for x in read(bytes(r.a), b"", np.frombuffer(r.doc, np.int64), np.frombuffer(r.pos, np.int32))[0]}
    assert place(again) < place(sent)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maximal_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "a\x01", "\x01", "c", "d", "é"]
    passage = [rng.choice(vocabulary) for _ in range(14)]
    texts = []
    for d in range(30):
        cut = sorted(rng.sample(range(15), 2))
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + passage[cut[0]:cut[1]] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        texts.append((d, " ".join(body)))
    texts += [(40, " ".join(passage)), (41, " ".join(passage)), (42, "q " + " ".join(passage * 2)), (43, None), (44, "")]
    cfg = Repeats(window=3, gram=2, reach=60)
    got = maximal_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), cfg=cfg).collect()
    assert {r.words: (r.places, r.doc_id, r.pos) for r in got} == brute_maximal(texts, 3) and len(got) > 60
    assert all(r.n_words == len(words(r.words)) and not r.cut for r in got)
    short = maximal_repeats(spark.createDataFrame(texts, "doc_id long, text string"), cfg=Repeats(window=3, gram=2, reach=5)).collect()
    assert {r.words for r in short if not r.cut} >= {w for w in brute_maximal(texts, 3) if len(words(w)) < 5}
    kept = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), cfg=cfg).drop("kept_text").collect()
    assert sorted(map(tuple, kept)) == sorted(brute_repeats(texts, 3))


def test_trees_from_common_words():
    from nearfd.llm.suffixes import common_words, deep_nodes, inner_nodes

    assert [common_words(*x) for x in ((b"a b c", b"a b"), (b"a b", b"a bc"), (b"a", b"b"), (b"ab c", b"ab c"), (b"", b"a"))] == [2, 1, 0, 2, 0]
    texts = np.array([b"x y z", b"x y", b"x\x01 y", b"x y\x01", b"x y z w", b"u"], object)
    order, shared, node = deep_nodes(texts, 2)
    assert [texts[i] for i in order] == [b"u", b"x y", b"x y z", b"x y z w", b"x y\x01", b"x\x01 y"]
    assert shared.tolist() == [0, 0, 2, 3, 1, 0] and inner_nodes(shared, 2) == [(3, 2, 3), (2, 1, 3)]


# ------------------------------------------------------------------ op6

def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in Q.RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, data):
    odd = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.NET/x?y"), (5, "http://a.net"), (6, "http://example.net/en/1#z://b"),
           (7, "http://xnet/"), (7, "http://xnet/"), (None, "http://b.org/fr/1"), (8, "http://É.org/fr/"), (9, "https://" + "a" * 50_000 + ".net/")]
    got = judge_urls(spark.createDataFrame(odd, "page_id long, url string"), Q.RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_rule(u)) for i, u in odd)
    assert all(r.verdict == Q.RULES[r.rule] for r in got if r.rule)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), Q.RULES).count() == 0
    pages = Q.op6_url_models(spark, data).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert {(r.page_id, r.host, r.path, r.rule) for r in pages} == {(i, *brute_rule(u)) for i, u in urls.items()}


def test_url_models_tell_kinds_apart(spark):
    rows = [(i, f"http://good-{i % 40}.org/fr/{i}") for i in range(400)] + [(1000 + i, f"http://bad{i % 40}.net/win/{i}") for i in range(400)]
    rows += [(5000, "http://good-7.info/fr/99"), (5001, "http://bad7.info/win/99")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), Q.RULES).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def brute_scores(urls, learn, order=5):
    """Witten-Bell log ratios with dictionaries; ``learn`` gives 1, 0 or None per URL."""
    chars = [(b"\x02" * order + (u or "").lower().encode() + b"\x03") for u in urls]
    counts = {v: defaultdict(Counter) for v in (0, 1)}
    for raw, v in zip(chars, learn, strict=True):
        for at in range(order, len(raw)):
            for k in range(order + 1):
                if v is not None:
                    counts[v][raw[at - k:at]][raw[at]] += 1

    def p(v, raw, at):
        out = 1 / 257
        for k in range(order + 1):
            c = counts[v].get(raw[at - k:at])
            if c:
                out = (c[raw[at]] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    return [np.mean([math.log(p(1, raw, at) / p(0, raw, at)) for at in range(order, len(raw))]) for raw in chars]


def test_url_scores_are_exact(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-_É"))
    rows = [(i, f"http://{''.join(rng.choice(letters, 12))}.{('net', 'org', 'com')[i % 3]}/fr/{''.join(rng.choice(letters, 60))}") for i in range(3000)]
    rows += [(3000, None), (3001, ""), (3002, rows[0][1])]
    table = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    held = {r.page_id for r in table.filter(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    rules = [brute_rule(u)[2] for _, u in rows]
    learn = [None if i in held or not rule else int(Q.RULES[rule] == "allow") for (i, _), rule in zip(rows, rules, strict=True)]
    got = {r.page_id: r.score for r in judge_urls(table, Q.RULES).collect()}
    assert np.allclose([got[i] for i, _ in rows], brute_scores([u for _, u in rows], learn), atol=1e-9)


# ------------------------------------------------------------------ op7

@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_is_continuous(dims):
    bits = 3
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_op7(spark, data, docs, odd, empty):
    got = Q.op7_hilbert_shards(spark, data).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    few = hilbert_shards(odd.withColumn("shard", F.lit("old")), ["text", "row"], 24, "doc_id")
    assert few.columns == ["doc_id", "text", "row", "epochs", "shard", "slot"] and few.count() == len(ODD)
    assert hilbert_shards(empty, ["text"], 24, "doc_id").count() == 0


def test_shards_prune_files(spark, tmp_path):
    """Filters on any of the dimensions rule out most files by their minima and maxima; shards by hash rule out none."""
    rng = np.random.default_rng(3)
    rows = [(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(rng.integers(0, 1000, (6000, 3)))]
    df = spark.createDataFrame(rows, "doc_id long, a int, b int, c int")
    placed = hilbert_shards(df, ["a", "b", "c"], 64, "doc_id").withColumn("hashed", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    read = {}
    for by in ("shard", "hashed"):
        spans = placed.groupBy(by).agg(*[F.min(c).alias(f"lo_{c}") for c in "abc"], *[F.max(c).alias(f"hi_{c}") for c in "abc"]).collect()
        read[by] = [sum(r[f"lo_{c}"] <= x + 50 and r[f"hi_{c}"] >= x for r in spans) / len(spans) for c in "abc" for x in (100, 470, 900)]
    assert max(read["shard"]) <= 0.6 and np.mean(read["shard"]) < 0.4 and min(read["hashed"]) == 1.0


# ------------------------------------------------------------------ op8

def test_marginals_equal_enumeration():
    doc, emit = np.array([0, 0, 0, 1, 1, 2]), np.array([0.3, -1.0, 2.0, 0.5, 0.1, -0.7])
    pair = np.array([[0.4, -0.2], [0.1, 0.9]])
    good, joint, norm = marginals(doc, emit, pair)
    total, want, pairs = 0.0, np.zeros(6), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, by, two = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for code in range(1 << len(at)):
            y = [(code >> i) & 1 for i in range(len(at))]
            p = math.exp(sum(emit[a] * v for a, v in zip(at, y)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += p
            by += p * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += p
        want[at], pairs, total = by / z, pairs + two / z, total + math.log(z)
    assert np.allclose(good, want) and np.allclose(joint, pairs) and np.isclose(norm, total)


def test_quality_on_held_out_rows(spark, odd, empty):
    data = "/root/testdata/sf0.01"
    got = Q.op8_line_crf(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) >= 0.95
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    model = train(odd, labels, cfg=LineCrf(steps=5))
    scored = score_quality(odd, model)
    assert scored.columns == [*odd.columns, "score"] and scored.count() == len(ODD)
    assert all(r.score == 0 for r in scored.collect() if not words(r.text))
    assert train(odd, labels.limit(0)) is None and score_quality(empty, None).count() == 0


def test_quality_of_long_and_missing_documents(spark):
    good = lambda i, n: "\n".join(f"This is line {j} of the text {i}, and it reads like a plain sentence." for j in range(n))
    bad = lambda i, n: "\n".join(f"$$$ {i} | {j} ### BUY" for j in range(n))
    rows = [(i, good(i, 30) if i % 2 else bad(i, 500)) for i in range(40)] + [(90, good(90, 500)), (91, bad(91, 30)), (92, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(1000, 1400)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(table, train(table, labels, cfg=LineCrf(sample=8, steps=60))).collect()}
    assert got[90] > 0.5 > got[91] and got[92] == 0
    prior = train(table.filter("doc_id >= 90"), labels)
    assert {r.doc_id: r.score for r in score_quality(table, prior).collect()} == {i: 0.5 * (i != 92) for i, _ in rows}
    with pytest.raises(Exception, match="no labels"):
        score_quality(table, None).collect()


# ------------------------------------------------------------------ op9

def brute_budgets(leaves, total, cap):
    """``leaves``: path -> weights per level; ``cap``: path -> tokens that it can give."""
    def fill(paths, depth, budget):
        if depth == len(next(iter(paths))):
            return {p: budget for p in paths}
        kids = defaultdict(list)
        for p in paths:
            kids[p[depth]].append(p)
        room = {k: sum(cap[p] for p in ps) for k, ps in kids.items()}
        weight = {k: leaves[ps[0]][depth] for k, ps in kids.items()}
        got, open_, left = {}, set(kids), budget
        while open_:
            level = left / sum(weight[k] for k in open_)
            full = [k for k in open_ if room[k] < level * weight[k]]
            if not full:
                got |= {k: level * weight[k] for k in open_}
                break
            for k in full:
                got[k] = room[k]
                left -= room[k]
                open_.remove(k)
        return {q: v for k, ps in kids.items() for q, v in fill(ps, depth + 1, got[k]).items()}

    return fill(list(leaves), 0, total)


def brute_mix(rows, leaves, share, epochs, seed):
    have = Counter()
    for _, path, n in rows:
        have[path] += n
    budget = brute_budgets(leaves, sum(have.values()) * share, {p: have[p] * epochs for p in leaves})
    out = {}
    for path, b in budget.items():
        mine = [(i, n) for i, p, n in rows if p == path]
        full = min(epochs, math.floor((round(b, 6) + 1e-6) / have[path])) if have[path] else 0
        rest = round(b, 6) - full * have[path] if full < epochs else 0
        done = 0
        for i, n in sorted(mine, key=lambda r: hashlib.md5(f"{seed}:{full + 1}:{r[0]}".encode()).hexdigest()):
            take = full + (1 if done < rest else 0)
            done += n
            if take:
                out[i] = take
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (0.9, 1), (1.5, 2)])
def test_op9_equals_brute_force(spark, data, docs, share, epochs):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = table.select("doc_id", Q.domain_of(F.col("source")).alias("domain"), "lang", "source", F.lit(1).alias("full"))
    rows = rows.join(spark.createDataFrame([(i, len(words(t))) for i, t in docs.items()], "doc_id long, n_tokens long"), "doc_id")
    tree = Q.source_tree(rows)
    leaves = {(r.domain, r.lang, r.source): (r.w_domain, r.w_lang, r.w_source) for r in tree.collect()}
    plain = [(r.doc_id, (r.domain, r.lang, r.source), r.n_tokens) for r in rows.collect()]
    got = mix_sources(rows, tree, Q.LEVELS, "doc_id", "n_tokens", share=share, max_epochs=epochs, seed=3)
    assert got.columns == [*rows.columns, "epochs"]
    assert {r.doc_id: r.epochs for r in got.collect()} == brute_mix(plain, leaves, share, epochs, 3)


def test_op9_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 5, "x"), (2, None, None, "x"), (None, "a", 0, "x"), (3, "c", -2, "x"), (4, "gone", 9, "x")],
                                 "doc_id long, lang string, n long, epochs string")
    tree = spark.createDataFrame([("a", 1.0), (None, 1.0), ("c", None), ("empty", 1.0)], "lang string, w_lang double")
    got = mix_sources(rows, tree, ["lang"], "doc_id", "n", share=1.0)
    assert got.columns == ["doc_id", "lang", "n", "epochs"] and {r.doc_id for r in got.collect()} >= {1}
    assert "gone" not in {r.lang for r in got.collect()}
    assert mix_sources(rows.limit(0), tree, ["lang"], "doc_id", "n").count() == 0


def test_op9_is_native(spark, data):
    plan = Q.op9_hierarchical_budgets(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ op10

PAGE = ("<html><head><title>T</title></head><body><header>Site</header><nav><a href=1>menu</a></nav><div class='ad'>buy now, buy all of it</div>"
        "<div id=content><h1>Head &amp; line</h1><p>First  para\ngraph of the <b>article</b>, which is <a href=2>long</a> enough.<br>More."
        "<p>Second &lt;para&gt;<script>var x='</p>';</script> here, also with some words in it.<ul><li>one<li>two</ul></div>"
        "<div class=comments><p>I like this comment of mine, it is long and dense.</p></div><form>name</form><footer>end</footer></body></html>")


def test_main_text(spark):
    want = "Head & line\nFirst para graph of the article, which is long enough. More.\nSecond <para> here, also with some words in it.\none\ntwo"
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<nav>only</nav>") == ""
    assert main_text("plain text") == "plain text" and main_text("<p>open <b>never") == "open never"
    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    got = extract_pages(rows).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, len(want)), (1, len(want)), (2, 0), (None, 4)])


def test_op10_whole_articles(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in Q.op10_text_density(spark, data).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def _long(n):
    return ("word " * n)[:n].strip().ljust(n, "x")


def test_main_text_keeps_what_is_beside_a_long_list():
    items = [_long(60) for _ in range(20)]
    blocks = [_long(30), *[_long(100)] * 4, "A short h3", *items, "See also", "The end."]
    tags = ["h1", *["p"] * 4, "h3", *["li"] * 20, "h4", "p"]
    inner = "".join(("<ul>" if i == 6 else "") + f"<{t}>{b}</{t}>" + ("</ul>" if i == 25 else "") for i, (t, b) in enumerate(zip(tags, blocks, strict=True)))
    want = "\n".join(blocks)
    for outer in ("<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<article><section>%s</section></article>", "%s"):
        assert main_text(f"<html><body>{outer % inner}</body></html>") == want, outer
    table = inner.replace("<ul>", "<table><tr><td>").replace("</ul>", "</td></tr></table>").replace("<li>", "<div>").replace("</li>", "</div>")
    assert main_text(f"<body><article>{table}</article></body>") == want
    boxed = inner.replace("<ul>", "<div><ul>").replace("</ul>", "</ul></div>")
    assert main_text(f"<body><div>{boxed}</div></body>") == want
    nested = f"<section><h2>One</h2>{inner}</section><section><h2>Two</h2><p>Brief.</p></section>"
    assert main_text(f"<body><main>{nested}</main></body>") == f"One\n{want}\nTwo\nBrief."


def test_main_text_keeps_strings_inline_and_links():
    items = "".join(f"<li>{_long(60)}</li>" for _ in range(20))
    listed = "\n".join([_long(60)] * 20)
    page = f"<body><div>Bare <b>bold</b> text<ul>{items}</ul><p><a href=1>linked words only</a></p>tail</div></body>"
    assert main_text(page) == f"Bare bold text\n{listed}\nlinked words only\ntail"
    page = f"<body>Bare <i>text</i><div><ul>{items}</ul></div><p>Short.</p><ul><li><a href=1>menu entry</a></ul></body>"
    assert main_text(page) == f"Bare text\n{listed}\nShort."


def test_main_text_inside_named_wrappers():
    inner = "<h1>Title</h1><p>Some words of text here.</p><p>More words of it.</p>"
    want = "Title\nSome words of text here.\nMore words of it."
    side = "<div class=sidebar><p>Words of a sidebar.</p></div><div id=comments><p>I like it, and here is why I do so, at great length, once more.</p></div>"
    for name in ("layout has-sidebar", "no-comments content", "page with-share-bar", "side-by-side", "legal-content", "search related"):
        assert main_text(f"<body><div class='{name}'><article>{inner}</article></div>{side}</body>") == want, name
        assert main_text(f"<body><div class='{name}'><main><div>{inner}</div></main>{side}</div></body>") == want, name
    assert main_text(f"<body><div class='notice-board'>{inner}</div><div class=sidebar>Words.</div></body>") == want
    head = inner.replace("<h1>Title</h1>", "<div class='post-header'><h1>Title</h1></div>")
    assert main_text(f"<body><article>{head}</article>{side}</body>") == want
    assert main_text(f"<body><div>{head}</div>{side}</body>") == want
    assert main_text(f"<body><div class=header>Site</div><article>{head}<div class='share-buttons'>Share this</div></article>"
                     f"<ul class=comments><li><article>{inner * 3}</article></ul></body>") == want


# ------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, data, docs):
    table = spark.read.parquet(f"{data}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.quality and len(corpus_pipeline.STAGES) == 5
    judged_ = corpus_pipeline.quality(spark, table, data)
    assert judged_.columns == table.columns and judged_.count() > 0.6 * len(docs)
    clean = corpus_pipeline.decontaminate(spark, table, data)
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in docs.items() if not any(b in t for b in bench)}
    mixed = corpus_pipeline.mix(spark, table, data)
    assert mixed.columns == table.columns and 0 < mixed.count() < len(docs)
    out = corpus_pipeline.run(spark, data)
    assert out.columns == [*table.columns, "shard", "slot"]
    rows = out.collect()
    assert len({r.text for r in rows}) == len(rows) == len({r.doc_id for r in rows})


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x y {item}"), (None, "a clean text without an id"), (None, None), (7, item), (7, "a clean text of a shared id"), (8, "clean")]
    clean = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter(tuple(r) for r in clean.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


CLASHES = ("_id", "_key", "_doc", "_th", "_score", "_scored", "_domain", "_tokens", "_epochs", "row", "key", "hit", "c0", "domain", "tokens",
           "epochs", "score", "rank")


def test_stages_on_odd_tables(spark, data, tmp_path):
    """Null and repeated ids, repeated rows, null columns, clashing names and empty tables, stage by stage."""
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    few = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    strange = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD if len(t or "") < 1000], few.schema)
    table = few.unionByName(few.limit(3)).unionByName(strange).withColumns({c: F.lit("x") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        want = [*table.columns, "shard", "slot"] if name == "sharding" else table.columns
        rows = out.collect()
        assert out.columns == want and len(rows) <= table.count(), name
        assert all(r.row == "x" and r.rank == "x" for r in rows)
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.shard(spark, table, str(tmp_path)).count() == table.count()


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and len(Q.QUERIES) == 14
