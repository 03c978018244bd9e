"""Vector codes, hard negatives and secret scans against brute force, on small tables and on odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfd.llm import negatives, secrets
from nearfd.llm import queries as Q
from nearfd.llm.codebooks import Codes, codebooks_digest, compress_vectors, part_bounds, part_distances, vector_codes
from nearfd.llm.negatives import Mining, bins, centroids_of, hard_negatives
from nearfd.llm.secrets import find_secrets, text_spans, value_ownership

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


def ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def some_vectors(n, dims, seed=1, copies=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], rng.choice([0, 1, 2, None])) for i in range(n)]
    return rows + [(n + i, rows[3][1], i % 3) for i in range(copies)]


ODD = [(900, None, 1), (901, [None] * 8, 1), (902, [NAN] * 8, 0), (903, [INF] * 8, None), (904, [1.0] * 5, 0), (905, [], 0)]


# ------------------------------------------------------------------ op11

def brute_codes(rows, cfg):
    kept = sorted(((i, ints(v), label) for i, v, label in rows if whole(v) and len(v) == 8), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bounds = part_bounds(8, cfg.parts)
    books = [[v[lo:hi] for _, v, _ in kept[:cfg.entries]] for lo, hi in bounds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(cfg.rounds):
        for p, (lo, hi) in enumerate(bounds):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(p, v[lo:hi])].append(v[lo:hi])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        codes = [nearest(p, v[lo:hi]) for p, (lo, hi) in enumerate(bounds)]
        error = sum(far(v[lo:hi], books[p][codes[p]]) for p, (lo, hi) in enumerate(bounds))
        by_label[label] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], sha) for i, code, error, label in out)


@pytest.mark.parametrize("n,parts,entries", [(60, 4, 16), (5, 4, 16), (70, 3, 64), (40, 16, 7)])
def test_codes_equal_brute_force(spark, n, parts, entries):
    rows = some_vectors(n, 8, copies=9) + ODD + [(None, [0.5] * 8, None), (2, [0.25] * 8, 1), (2, [0.25] * 8, 1)]
    random.Random(2).shuffle(rows)
    cfg = Codes(parts=parts, entries=entries)
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "v", "n", "code", "of", "error")})
    assert Counter(tuple(r) for r in vector_codes(table, cfg=cfg).collect()) == brute_codes(rows, cfg)


def test_op11_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = Q.op11_value_dictionaries(spark, data)
    want = con.execute(Q.ORACLE_SQL["op11_value_dictionaries"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes(none).count() == 0 and vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes(spark.createDataFrame(ODD[:4], VECTORS)).count() == 0
    named = spark.createDataFrame([("a", [1.0, -1.0], "x"), ("b", [1e30, 0.0], None)], "vec_id string, embedding array<double>, label string")
    codes, books = compress_vectors(named, cfg=Codes(parts=2, entries=2))
    assert sorted((r.vec_id, r.error) for r in codes.collect()) == [("a", 0), ("b", 0)]  # huge components count as the largest
    assert [b.shape for b in books] == [(2, 1), (2, 1)] and codebooks_digest([]) == hashlib.sha256(b"").hexdigest()


def test_gathers_equal_subtractions():
    rng = np.random.default_rng(1)
    for top in (300, 2**27):
        rows, book = rng.integers(-top, top, (50, 3)), rng.integers(-top, top, (9, 3))
        pairs = [np.unique(rows[:, d], return_inverse=True) for d in range(3)]
        got = part_distances([u for u, _ in pairs], np.stack([c for _, c in pairs], 1), book)
        assert (got == ((rows[:, None] - book[None]) ** 2).sum(2)).all()


# ------------------------------------------------------------------ op12

def brute_negatives(rows, anchors, dims, k=5):
    one = {}
    for i, v, label in rows:
        if i is not None and label is not None and whole(v) and len(v) == dims:
            one[i] = min(one.get(i, (label, ints(v))), (label, ints(v)))
    out = set()
    for a in one:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(one[a][1], v)), i, label == one[a][0]) for i, (label, v) in one.items() if i != a)
        for s, p, _ in [r for r in scored if r[2]][:k]:
            fit = [(i, -t) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(fit, 1)}
    return out


SMALL = Mining(block_cells=8 * 24, step=4, clusters=7)


@pytest.mark.parametrize("cfg", [Mining(), SMALL])
def test_negatives_equal_brute_force(spark, cfg):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)], rng.choice([0, 1, 1, 1, 2, None])) for i in range(240)]
    rows += [(300 + i, rows[8][1], i % 2) for i in range(60)]  # a hot vector in both labels, ties by id
    rows += [(400, [0.0] * 8, 1), (404, [0.0] * 8, 2), (408, [-3.0] * 8, 3), (8, rows[8][1], rows[8][2]), (12, [9.0] * 8, 0), (None, [1.0] * 8, 1)]
    rows += [(i, v, label) for i, v, label in ODD]
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "v", "cluster", "tile", "anchor", "score", "slot")})
    got = {tuple(r) for r in hard_negatives(table, F.expr("id % 4 = 0"), cfg=cfg).collect()}
    want = brute_negatives(rows, lambda i: i % 4 == 0, 8)
    assert got == want and len(want) > 300


def test_op12_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(Q.ORACLE_SQL["op12_shared_lists"]).fetchall()
    assert sorted(map(tuple, Q.op12_shared_lists(spark, data).collect())) == sorted(want)


def test_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none, F.expr("id % 100 = 0")).count() == 0
    assert hard_negatives(spark.createDataFrame(ODD, VECTORS), F.expr("id % 100 = 0")).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1), (7, [1.0, 2.0], 2)], VECTORS)
    assert hard_negatives(alone, F.expr("id % 100 = 0")).count() == 0  # no other row of its label


def test_walks_end_early():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 20, (4000, 8)) + np.repeat(np.eye(8) * 900, 500, axis=0))
    seen, plain = 0, negatives.products

    def counted(a, b):
        nonlocal seen
        seen += len(b)
        return plain(a, b)

    negatives.products = counted
    try:
        a, labels = v[:5], np.zeros(4000, np.int64)
        centre = a.mean(0) / np.linalg.norm(a.mean(0))
        slot, score, place = negatives._walk(
            np.arange(4000), labels, v, np.linalg.norm(v, axis=1), np.arange(5), labels[:5], a, np.linalg.norm(a, axis=1), centre, True,
            np.full((5, 1), -np.inf), np.full((5, 1), np.inf), 5, 100)
    finally:
        negatives.products = plain
    assert seen <= 1000 and len(slot) == 25
    for m in range(5):
        full = plain(a[m:m + 1], v)[0]
        full[m] = -10**9
        assert set(score[slot == m]) == set(np.sort(full)[-5:])


def test_bins_have_bounded_sizes():
    counts = [3, 900, 2, 0, 5, 90, 20, 250, 1]
    first, pieces = bins(counts, 100)
    load = Counter()
    for c, (f, p) in enumerate(zip(first, pieces)):
        for i in range(p):
            load[f + i] += counts[c] / p
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert len(centroids_of(np.ones((50, 3)), 7)) == 1 and len(centroids_of(np.zeros((0, 3)), 7)) == 0


# ------------------------------------------------------------------ op13

KEY = "AKIA" + "Q7" * 8
LIVE, COPIED = "Zx81kQ0pLm27Ty5v", "Ab12Cd34Ef56Gh78"
CASES = [
    ("password=hunter2hunter2", [(0, 0, 23)]),
    ('API_KEY": "abc.def/ghi=" x', [(0, 0, 23)]),
    ("apikey : 'short' token=", []),
    ("\N{LATIN SMALL LETTER LONG S}ecret=abcdefgh1", []),
    ("tokentoken==abcdefgh", [(5, 0, 20)]),
    (f"é漢😀 {KEY} " + "0f" * 16, [(4, 1, 24), (25, 2, 57)]),
    ("AKIAAKIA short AKIA" + "A" * 12, [(15, 1, 31)]),
    ("g" + "a1" * 16 + "g", [(1, 2, 33)]),
    (f"x {LIVE} y", [(2, 3, 18)]),
    ("onlyletterswithoutanynumber 12345678901234567890", []),
    ("secret=" + LIVE, [(0, 0, 23)]),
    ("token=a1b2c3d4e5f6a7b8c9d0a1b2c3d4e5f6a7b8", [(0, 0, 42), (6, 2, 42)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_spans_of_a_text(text, want):
    assert [(s, k, e) for s, k, e, _ in text_spans(text)] == sorted(want)


def test_secrets_by_ownership(spark):
    rows = [(i, f"see {COPIED} here", f"o{i % 3}", "en") for i in range(30)] + [(100 + i, f"mine {LIVE}", "o9", "en") for i in range(5)]
    rows += [(200 + i, f"password={COPIED[:9]}", f"p{i}", "de") for i in range(4)] + [(300, "secret=abcdefgh", None, None), (300, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    table = table.withColumns({c: F.lit(1) for c in ("id", "owner", "repo", "row", "value", "spans", "list", "start", "example")})
    got = defaultdict(list)
    for r in find_secrets(table).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].spans == "" and got[i][0].n_token == 0 for i in range(30))  # three owners copy it
    assert all(got[100 + i][0].spans == "token:5:21" for i in range(5))  # one owner has it
    assert all((got[200 + i][0].spans, got[200 + i][0].n_examples) == ("assign:0:18", 1) for i in range(4))  # the fixed patterns stay
    assert sorted((r.spans, r.n_assign) for r in got[300]) == [("", 0), ("assign:0:15", 1)]
    assert got[300][0].base_sha256 != got[300][1].base_sha256 and {r.base_sha256 for r in got[0]} == {hashlib.sha256(b"").hexdigest()}


def test_secrets_of_odd_tables(spark):
    kind = "doc_id string, text string, source string, lang string"
    assert find_secrets(spark.createDataFrame([], kind)).count() == 0
    long = "word " * 200_000 + f"password={LIVE}"
    rows = [("a", long, "s", "en"), ("a", long, "s", "en"), (None, "", None, "en"), (None, " \n", "s", None)]
    got = find_secrets(spark.createDataFrame(rows, kind))
    assert dict(got.dtypes)["doc_id"] == "string"
    assert Counter((r.doc_id, r.spans) for r in got.collect()) == Counter({("a", f"assign:1000000:{1000009 + len(LIVE)}"): 2, (None, ""): 2})


def test_ownership_counts(spark):
    rows = [("o1", "r1", [b"x", b"x", b"y"]), ("o1", "r2", [b"x"]), ("o2", "r1", [b"x"]), (None, "r1", [b"y"])]
    table = spark.createDataFrame([(o, r, [(0, 0, 1, v) for v in vs]) for o, r, vs in rows],
                                  "owner string, repo string, spans array<struct<start:int,kind:int,end:int,value:binary>>")
    got = {bytes(r.value): (r.n_owners, r.n_repos, r.n_places, r.example) for r in value_ownership(table).collect()}
    assert got == {b"x": (2, 3, 4, False), b"y": (2, 2, 2, False)}


def test_op13_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cur = con.execute(Q.ORACLE_SQL["op13_secret_ownership"])
    names = [c[0] for c in cur.description]
    got = Q.op13_secret_ownership(spark, data)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall()) and set(got.columns) == set(names)


def test_sql_of_planted_secrets(spark):
    rows = [(i, t, f"o{i % 5}", "en") for i, t in enumerate([t for t, _ in CASES] + [f"see {COPIED}"] * 9 + [None, ""])]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    documents = table.toPandas()  # noqa: F841 - read by the SQL
    con = duckdb.connect()
    cur = con.execute(secrets.secrets_sql())
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, find_secrets(table).select(*names).collect())) == sorted(cur.fetchall())
