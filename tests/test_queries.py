import random

import pytest
from pyspark.sql import functions as F

import brute
from nearfd import (
    Predicate, QuerySpec, Rfd, column_values, extend_query, extent_pct, format_islands, is_consecutive, make_rfds,
    mark_rows, relax_best, relax_columns, relax_counts, relax_rows, relaxing_attributes, similar_values,
    similarity_join, sort_table, string_pairs, value_islands)

ROWS = [(1, "john", 20, 1.5), (2, "jack", 21, 2.5), (3, "mary", 45, None), (4, None, 48, 2.0),
        (5, "eric", None, 16.5), (6, "joh", 30, 17.0), (7, "[x", 0, 3.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id int, name string, age int, score double").cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("pred,want", [
    (("age", "=", 20), [1]),
    (("name", "=", "mary"), [3]),
    (("age", "!=", 20), [2, 3, 4, 5, 6, 7]),
    (("name", "≠", "john"), [2, 3, 4, 5, 6, 7]),
    (("age", "in", [20, 21]), [1, 2]),
    (("name", "∉", ["john", "jack"]), [3, 4, 5, 6, 7]),
    (("age", ">", 45), [4]),
    (("age", ">=", 45), [3, 4]),
    (("age", "<", 21), [1, 7]),
    (("age", "<=", 21), [1, 2, 7]),
    (("age", "=", 0), [7]),
    (("name", "~", "j.*h"), [1, 6]),
    (("name", "=", ""), [1, 2, 3, 4, 5, 6, 7]),
    (("name", "=", None), [1, 2, 3, 4, 5, 6, 7]),
])
def test_predicates(people, pred, want):
    assert ids(QuerySpec([pred]).apply(people)) == want


def test_long_lists_become_semi_joins(people):
    spec = QuerySpec([("age", "in", list(range(15, 5000)))])
    assert ids(spec.apply(people)) == [1, 2, 3, 4, 6]


def test_dict_form(people):
    q = QuerySpec.from_dict
    assert ids(q({}).apply(people)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(q({"age": range(20, 31)}).apply(people)) == [1, 2, 6]
    assert ids(q({"age": {"min": 20, "max": 30}, "name": "j%"}).apply(people)) == [1, 2, 6]
    assert ids(q({"name": "%oh%"}).apply(people)) == [1, 6]
    assert ids(q({"name": "%ck"}).apply(people)) == [2]
    assert ids(q({"age": [20, 48]}).apply(people)) == [1, 4]


def test_operator_form_text_and_json(people):
    spec = QuerySpec.from_operators({"age": ">", "name": "="}, {"age": 19, "name": "john"})
    assert ids(spec.apply(people)) == [1]
    assert spec.pretty() == "Age > 19 AND Name = john"
    assert QuerySpec().pretty() == "All"
    assert QuerySpec([("shoe_size", "in", [1, 2])]).pretty() == "Shoe Size ∈ [1, 2]"
    assert ids(QuerySpec.from_json(spec.to_json()).apply(people)) == [1]
    assert spec.fields == ["age", "name"]
    with pytest.raises(ValueError):
        QuerySpec.from_operators({"a": "="}, {"b": 1})
    with pytest.raises(ValueError):
        QuerySpec([("a", "??", 1)])


def test_typed_strings(people):
    spec = QuerySpec.from_strings(people, [("age", "∈", "[20, 21]"), ("name", "=", "jack")])
    assert spec.predicates[0].value == [20, 21] and ids(spec.apply(people)) == [2]
    with pytest.raises(ValueError):
        QuerySpec.from_strings(people, [("name", "<", "b")])


def test_extension_rules(people):
    rfd = Rfd({"age": 2.0, "name": 1.0}, "score", 0.5)
    ext = lambda *p, **k: extend_query(QuerySpec([p]), rfd, people, **k).predicates[0]
    assert ext("age", "=", 20) == Predicate("age", "ranges", [(18, 22)])
    assert ext("age", "=", 20, mode="integers") == Predicate("age", "integers", [(18, 22)])
    assert ext("age", "∈", [20, 40]).value == [(18, 22), (38, 42)]
    assert ext("age", ">", 20).value == 18.0 and ext("age", "≤", 20).value == 22.0
    assert ext("age", "between", (20, 30)).value == (18.0, 32.0)
    assert ext("age", "≠", 20) == Predicate("age", "≠", 20)
    assert ext("name", "=", "john") == Predicate("name", "similar", (["john"], 1.0))
    assert ext("id", "=", 3) == Predicate("id", "=", 3)
    assert ext("score", "=", 16.5).value == [(16, 17)]
    assert ext("score", "=", 16.5, mode="integers").op == "integers"
    assert ids(extend_query(QuerySpec([("name", "=", "john")]), rfd, people).apply(people)) == [1, 6]
    assert ids(extend_query(QuerySpec.from_dict({"name": "%oh"}), rfd, people).apply(people)) == [1, 6]
    assert ids(extend_query(QuerySpec.from_dict({"name": "%oh"}), rfd, people, anchored=True).apply(people)) == [1, 6]
    zero = Rfd({"age": 0.0}, "score", 0.5)
    assert extend_query(QuerySpec([("age", "=", 20)]), zero, people).predicates[0] == Predicate("age", "=", 20)


def test_extended_answers_contain_the_original(people):
    rfd = Rfd({"age": 3.0, "name": 2.0}, "score", 0.5)
    for p in [("age", "=", 20), ("age", "in", [20, 45]), ("age", ">", 30), ("name", "=", "jack"), ("name", "in", ["joh"])]:
        spec = QuerySpec([p])
        assert set(ids(spec.apply(people))) <= set(ids(extend_query(spec, rfd, people).apply(people)))


WORDS = ["", "a", "b", "ab", "ba", "abc", "abd", "acbd", "kitten", "sitting", "mitten", "smitten", "bitten",
         "héllo", "hallo", "hello", "yellow", "aaaaaaa", "aaaaaa", "aaabaaa", "xaaaaaa", "abcabcabc", "abcbcabc"]


@pytest.mark.parametrize("t,short", [(0, 0), (1, 256), (1, 0), (1, 5), (2, 64), (2, 0), (2, 6), (3, 0), (5, 0)])
def test_string_pairs(spark, monkeypatch, t, short):
    import nearfd.operators.simjoin as simjoin
    monkeypatch.setattr(simjoin, "DELETION_LENGTH", {t: short})
    rng = random.Random(t)
    left = WORDS + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    right = WORDS + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    a = spark.createDataFrame([(w,) for w in left], "s string")
    b = spark.createDataFrame([(w,) for w in right], "s string")
    got = sorted(tuple(r) for r in string_pairs(a, b, t).collect())
    assert got == sorted({(x, y) for x in left for y in right if brute.edit(x, y) <= t})


def sample(seed, n=70):
    rng = random.Random(seed)
    pick = lambda vals: rng.choice(vals)
    return [(i, pick([None, 1, 2, 3, 5, 8, 13]), pick([None, 0.5, 1.25, 2.0, 7.5, -3.25, -2.0]),
             pick([None, "", "ab", "abc", "bcd", "xyz", "xy", "abcd"])) for i in range(n)]


CASES = [
    {"n": ("abs", 1.0)}, {"n": ("abs", 0.0), "x": ("abs", 0.75)}, {"s": ("edit", 1)}, {"s": ("edit", 2), "n": ("abs", 2)},
    {"s": ("edit", 0)}, {"n": ("abs", brute.INF)}, {"s": ("edit", brute.INF), "x": ("abs", 1.25)},
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_similarity_join(spark, case):
    on = CASES[case]
    left, right = sample(1), sample(2, 40)
    a = spark.createDataFrame(left, "id int, n int, x double, s string")
    b = spark.createDataFrame(right, "id int, n int, x double, s string")
    pos = {"n": 1, "x": 2, "s": 3}
    near = lambda l, r: all(brute.gap(l[pos[c]], r[pos[c]]) <= t for c, (_, t) in on.items())
    pairs = sorted((l[0], r[0]) for l in left for r in right if near(l, r))
    got = similarity_join(a, b, on)
    assert sorted((r["id_l"], r["id_r"]) for r in got.collect()) == pairs
    hits = {p[0] for p in pairs}
    assert ids(similarity_join(a, b, on, "left_semi")) == sorted(hits)
    assert ids(similarity_join(a, b, on, "left_anti")) == sorted({l[0] for l in left} - hits)


def test_days_join(spark):
    a = spark.sql("select * from values (1, timestamp'2001-01-02 10:00:00'), (2, timestamp'2001-01-05 00:00:00'),"
                  "(3, null) as t(id, d)")
    got = similarity_join(a, a, {"d": ("days", 1)})
    assert sorted((r["id_l"], r["id_r"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]
    got = similarity_join(a, a, {"d": ("days", 2)})
    assert sorted((r["id_l"], r["id_r"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_band_join_plan(spark):
    a = spark.range(1000).selectExpr("id", "id * 0.5d as x", "cast(id as string) as s")
    for on in ({"x": ("abs", 1.0)}, {"s": ("edit", 1)}):
        plan = similarity_join(a, a, on, "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("thresholds", [
    {"n": 1.0, "x": 0.75}, {"n": 2.0, "s": 1.0}, {"s": 2.0}, {"x": 1.5, "n": 0.0, "s": 0.0}])
def test_relaxation(spark, thresholds):
    rows = sample(4)
    df = spark.createDataFrame(rows, "id int, n int, x double, s string").cache()
    rhs = next(iter(thresholds))
    rfd = Rfd({c: t for c, t in thresholds.items() if c != rhs}, rhs, thresholds[rhs])
    pos = {"n": 1, "x": 2, "s": 3}
    ans = rows[:5]
    answers = df.filter("id < 5")
    near = lambda c, r, a: brute.gap(r[pos[c]], a[pos[c]]) <= thresholds[c]
    by_row = sorted(r[0] for r in rows if any(all(near(c, r, a) for c in thresholds) for a in ans))
    by_col = sorted(r[0] for r in rows if all(any(near(c, r, a) for a in ans) for c in thresholds))
    assert ids(relax_rows(df, answers, rfd)) == by_row
    assert ids(relax_columns(df, answers, rfd)) == by_col
    assert set(by_row) <= set(by_col)

    def lattice(c, r, a):
        x, y, t = r[pos[c]], a[pos[c]], thresholds[c]
        if isinstance(x, str) or isinstance(y, str) or t == 0 or x is None or y is None:
            return near(c, r, a)
        return x in range(int(y - t), int(y + t + 1))

    by_row = sorted(r[0] for r in rows if any(all(lattice(c, r, a) for c in thresholds) for a in ans))
    full = df.dropna()
    whole = {r["id"] for r in full.collect()}
    ans_full = answers.dropna()
    ans = [a for a in ans if a[0] in whole]
    by_row = sorted(r[0] for r in rows if r[0] in whole and any(all(lattice(c, r, a) for c in thresholds) for a in ans))
    by_col = sorted(r[0] for r in rows if r[0] in whole and all(any(lattice(c, r, a) for a in ans) for c in thresholds))
    assert ids(relax_rows(full, ans_full, rfd, mode="integers")) == by_row
    assert ids(relax_columns(full, ans_full, rfd, mode="integers")) == by_col


def test_relaxation_to_integers_keeps_unknown_values(spark):
    rows = [(0, None, 10.0), (1, 5, 20.0), (2, None, 11.0), (3, None, 30.0), (4, 6, 21.0), (5, 6, None), (6, 5, None), (7, None, 10.5)]
    df = spark.createDataFrame(rows, "id int, n int, x double")
    rfd = Rfd({"n": 2.0}, "x", 2.0)
    assert ids(relax_rows(df, df.filter("id < 2"), rfd, mode="integers")) == [0, 1, 2, 4]
    assert ids(relax_columns(df, df.filter("id < 2"), rfd, mode="integers")) == [0, 1, 2, 4]
    assert ids(relax_rows(df, df.filter("id IN (1, 5)"), rfd, mode="integers")) == [1, 4, 5, 6]
    assert ids(relax_columns(df, df.filter("id IN (1, 5)"), rfd, mode="integers")) == [1, 4, 5, 6]
    assert ids(relax_rows(df, df.filter("id = 0"), rfd)) == [0, 2, 7]


def test_relax_columns_on_random_numbers_and_dates(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double").withColumn(
        "d", F.timestamp_micros((F.col("x") * 86_400_000_000).cast("bigint")))
    answers = df.filter("id < 6")
    for attr, near in (("x", lambda a, b: abs(a - b) <= 1.5), ("d", lambda a, b: abs(a - b) < 2.0)):
        rfd = Rfd({}, attr, 1.5 if attr == "x" else 1.0)
        want = sorted(i for i, x in rows if any(near(x, y) for _, y in rows[:6]))
        assert ids(relax_columns(df, answers, rfd)) == want
        assert ids(relax_rows(df, answers, rfd)) == want


def test_best_relaxation(spark):
    rows = sample(6)
    df = spark.createDataFrame(rows, "id int, n int, x double, s string").cache()
    spec = QuerySpec([("n", "=", 5)])
    raw = [({"n": 1.0}, "x", 0.0), ({"n": 0.0}, "x", 1.0), ({"n": 3.0}, "s", 1.0)]
    rfds = make_rfds(spark.createDataFrame(
        [(r, t, lhs) for lhs, r, t in raw], "rhs string, rhs_threshold double, lhs map<string,double>"))
    counts = {r["rfd_id"]: r for r in relax_counts(df, spec, [Rfd.from_row(r) for r in rfds.collect()]).collect()}
    for (lhs, rhs, t), row in zip(raw, rfds.collect(), strict=True):
        rfd = Rfd(lhs, rhs, t)
        ext = extend_query(spec, rfd, df).apply(df)
        assert counts[row["rfd_id"]]["n_extended"] == ext.count()
        assert counts[row["rfd_id"]]["n_relaxed"] == relax_rows(df, ext, rfd, query=spec).count()
        assert counts[row["rfd_id"]]["n_query"] == spec.apply(df).count()
    best = relax_best(df, spec, rfds).collect()
    above = [c["n_relaxed"] for c in counts.values() if c["n_relaxed"] > c["n_query"]]
    assert best[0]["n_relaxed"] == min(above)
    assert relaxing_attributes(df, Rfd({"n": 1.0}, "x", 0.0), spec) == ["x"]
    assert relaxing_attributes(df, Rfd({"x": 1.0}, "n", 0.0), QuerySpec([("n", "=", 1), ("x", "=", 1)])) == ["n"]


def test_extent_and_marks(people):
    row = extent_pct(people, QuerySpec([("age", ">", 20)])).first()
    assert (row["n_rows"], row["n_answers"], row["pct"]) == (7, 4, 57.14)
    marked = mark_rows(people, people.filter("age > 40"), "id")
    assert [r["selected"] for r in marked.orderBy("id").collect()] == [False, False, True, True, False, False, False]


def test_similar_values(spark):
    df = spark.createDataFrame([(" john",), ("jack",), ("joh",), ("mary",), ("john",)], "name string")
    got = {r["name"] for r in similar_values(df, "name", "john", 3).collect()}
    assert got == {w for w in [" john", "jack", "joh", "mary", "john"] if brute.edit(w, "john") <= 3}


def test_value_reports(spark, monkeypatch):
    import nearfd.operators.values as values
    monkeypatch.setattr(values, "ISLAND_RANGE", 8)
    rng = random.Random(2)
    nums = sorted({rng.randint(-20, 60) for _ in range(45)})
    df = spark.createDataFrame([(n,) for n in nums + nums[:3] + [None]], "v int")
    runs, start = [], nums[0]
    for a, b in zip(nums, nums[1:] + [None], strict=True):
        if b != a + 1:
            runs.append((start, a, a - start + 1))
            start = b
    got = sorted(tuple(r) for r in value_islands(df, "v").collect())
    assert got == runs
    text = format_islands(value_islands(df, "v")).first()["text"]
    assert text.split(" ∪ ")[0] == (f"[{runs[0][0]}-{runs[0][1]}]" if runs[0][2] > 1 else f"[{runs[0][0]}]")
    consecutive = lambda vs: is_consecutive(spark.createDataFrame([(v,) for v in vs], "v int"), "v").first()[0]
    assert consecutive([2000, 2001, 2002, 2003]) and not consecutive([2000, 2001, 2010, 2007])
    assert not consecutive([1, 2, 2, 3])
    t = spark.createDataFrame([(2, "b"), (10, "a"), (2, "a")], "n int, s string")
    assert [tuple(r) for r in column_values(t, ["n", "s"]).collect()] == [("n", "2"), ("n", "10"), ("s", "a"), ("s", "b")]
    assert [tuple(r) for r in sort_table(t, ["n", "s"], [False, True]).collect()] == [(10, "a"), (2, "a"), (2, "b")]


def test_long_lists_equal_short_ones(spark):
    df = spark.sql("SELECT cast(id AS double) AS d, cast(id AS int) AS i, date_add(date'2020-01-01', cast(id AS int)) AS day, "
                   "concat('s', id) AS s FROM range(30) UNION ALL SELECT NULL, NULL, NULL, NULL")
    for column, values in (("d", list(range(5, 1300))), ("i", [x + 0.0 for x in range(5, 1300)]), ("i", [5, 6.0, *range(2000, 3300)]),
                           ("day", [f"2020-01-{x:02}" for x in range(3, 9)] + [f"{y}-01-01" for y in range(2021, 3400)]),
                           ("s", [f"s{x}" for x in range(5, 1300)])):
        for op in ("∈", "∉"):
            long = Predicate(column, op, values)
            assert not long.is_plain()
            assert sorted(long.filter(df).collect(), key=str) == sorted(df.filter(long.condition()).collect(), key=str)


def test_wildcard_text_is_no_pattern(spark):
    df = spark.createDataFrame([("a(b1",), ("a(b2",), ("zz",)], "s string")
    spec = extend_query(QuerySpec([("s", "prefix", "a(b")]), Rfd({"s": 1.0}, "t", 0.0), df)
    assert spec.apply(df).count() == 2
    assert QuerySpec.from_dict({"i": range(0)}).predicates == ()


@pytest.mark.parametrize("t", [3, 4])
def test_strings_with_one_prefix(spark, monkeypatch, t):
    """All strings share a prefix: its grams are the most frequent ones and lead to no meeting; heavy keys are dealt."""
    import nearfd.operators.simjoin as S

    rng = random.Random(t)
    words = {"customer-with-a-long-name#" + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(15, 18))) for _ in range(300)}
    words |= {w[:30] + "x" + w[31:-1] for w in list(words)[:60]} | {w.replace("long", "lo") for w in list(words)[:20]}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "v string")
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= t and quick_edit(a, b, t)}
    for heavy in (512, 20):
        monkeypatch.setattr(S, "HEAVY", heavy)
        got = {tuple(r) for r in string_pairs(df, df, t).collect()}
        assert got == want and len(got) > len(words) + 100
    met = S._gram_pairs(df.toDF("l"), df.toDF("r"), t, t + 1).count()
    assert met < len(words) ** 2 / 10


def quick_edit(a, b, t):
    from brute import edit

    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not (a and b):
        return max(len(a), len(b)) <= t
    if len(set(a) - set(b)) > t or len(set(b) - set(a)) > t:
        return False
    return edit(a, b) <= t


def test_shared_scan_of_many_dependencies(spark, tmp_path, monkeypatch):
    """Counts equal those of one dependency at a time, and the table is scanned twice, whatever their number."""
    import nearfd.operators.relax as R

    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(9)]), rng.choice([None, float("nan"), float("inf"), *[x / 4 for x in range(20)]]),
             rng.choice([None, "ab", "abc", "xyz", "x"]), rng.choice("pq")) for i in range(150)]
    spark.createDataFrame(rows, "id int, n int, x double, s string, k string").withColumn(
        "d", F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, n, id % 24)")).repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spec = QuerySpec([("k", "=", "p"), ("n", ">", 2)])
    many = [Rfd({"n": 1.0, "x": 0.5}, "s", 1.0, "a"), Rfd({"x": 0.0, "s": 0.0}, "d", 2.0, "b"), Rfd({"d": 1.0, "x": 1.0}, "n", 2.0, "c"),
            Rfd({"x": float("inf")}, "d", 0.0, "d"), Rfd({"n": 2.0, "x": 1.0, "d": 3.0}, "s", 0.0, "e"), Rfd({"n": 0.0}, "x", 0.25, "f")]
    scans = []
    plain = R.materialize

    def noted(table, name="table"):
        scans.append(table)
        return plain(table, name)

    monkeypatch.setattr(R, "materialize", noted)
    for n in (1, 6):
        scans.clear()
        out = relax_counts(df, spec, many[:n])
        plans = [t._jdf.queryExecution().optimizedPlan().toString() + t._jdf.queryExecution().executedPlan().toString() for t in [*scans, out]]
        assert sum(p.count(f"{tmp_path}/t") for p in plans) == 2, n
        got = {r.rfd_id: r for r in out.collect()}
        assert len(got) == n
        for rfd in many[:n]:
            answers = extend_query(spec, rfd, df).apply(df)
            r = got[rfd.rfd_id]
            assert (r.n_query, r.n_extended, r.n_relaxed) == (
                spec.apply(df).count(), answers.count(), relax_rows(df, answers, rfd, query=spec).count()), rfd.rfd_id
    text = [Rfd({"s": 1.0}, "s", 1.0, "text only"), many[0]]
    assert {r.rfd_id for r in relax_counts(df, QuerySpec([("k", "=", "p")]), [Rfd({"n": 1.0}, "s", 2.0, "t"), many[1]]).collect()} == {"t", "b"}
    assert relax_counts(df, spec, text[:1]).count() == 1
