import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

import brute
from nearfd import (
    QuerySpec, Rfd, ancestors, append_results, bench_results, bench_summary, columns_with_role, dominates, filter_rfds,
    format_rfd, make_rfds, max_clique, name_rhs, pair_distances, rank_rfds, read_rfds, read_table, rfd_edges, rfd_extent, rfd_holds,
    rfd_nodes, rfd_threshold, rfd_violations, rfds_from_wide, rfds_to_wide, shared_dir, sniff_csv, table_profile,
    taxonomy_distance, union_wide, with_row_id, write_rfds, write_table)

WIDE = [("height", None, 1.0, None, 1.0), ("weight", 6.0, 1.0, None, 4.0), ("age", 5.0, None, 0.126, 1.0)]
WIDE_COLS = ["age", "height", "shoe_size", "weight"]


@pytest.fixture(scope="module")
def rfds(spark):
    wide = spark.createDataFrame(WIDE, "RHS string, age double, height double, shoe_size double, weight double")
    return rfds_from_wide(wide).cache()


def test_wide_and_map_forms(spark, rfds):
    by = {r["rhs"]: r for r in rfds.collect()}
    assert by["height"]["lhs"] == {"weight": 1.0} and by["height"]["rhs_threshold"] == 1.0
    assert by["age"]["lhs"] == {"shoe_size": 0.126, "weight": 1.0}
    back = {tuple(r) for r in rfds_to_wide(rfds, WIDE_COLS).collect()}
    assert back == set(WIDE)
    assert rfds_from_wide(rfds_to_wide(rfds, WIDE_COLS), digits=2).filter("rhs='age'").first()["lhs"]["shoe_size"] == 0.13
    a = spark.createDataFrame([(1.0, 2.0)], "RHS double, x double")
    named = name_rhs(a, ["x", "y"])
    assert named.columns == ["y", "x", "RHS"] and named.first().asDict() == {"y": 1.0, "x": 2.0, "RHS": "y"}
    both = union_wide([named, spark.createDataFrame([("q", 1.0)], "RHS string, q double")])
    assert both.filter("RHS = 'q'").first()["x"] is None
    got = {r["rhs"]: (r["a"], r["h"]) for r in rfds.select("rhs", rfd_threshold("age").alias("a"),
                                                            rfd_threshold("height").alias("h")).collect()}
    assert got == {"height": (None, 1.0), "weight": (6.0, 1.0), "age": (5.0, None)}


def test_text_forms(rfds):
    t = {r["rhs"]: r["text"] for r in format_rfd(rfds, "human", WIDE_COLS).collect()}
    assert t["weight"] == "age(<= 6.0), height(<= 1.0), -> weight(<= 4.0)"
    assert t["age"] == "shoe_size(<= 0.13), weight(<= 1.0), -> age(<= 5.0)"
    t = {r["rhs"]: r["text"] for r in format_rfd(rfds, "arrow", WIDE_COLS).collect()}
    assert t["age"] == "(shoe_size <= 0.126) (weight <= 1.0) ---> (age <= 5.0)"
    t = {r["rhs"]: r["text"] for r in format_rfd(rfds, "unicode").collect()}
    assert t["age"] == "(Shoe Size ≤ 0.126, Weight ≤ 1.0) → (Age ≤ 5.0)"
    empty = rfds.limit(1).withColumn("lhs", F.map_filter("lhs", lambda k, v: F.lit(False)))
    assert format_rfd(empty, "unicode").first()["text"] == ""
    assert format_rfd(empty.withColumn("rhs", F.lit(None).cast("string")), "arrow").first()["text"] == "None"


def test_filter_and_rank(rfds):
    names = lambda df: [r["rhs"] for r in df.collect()]
    assert set(names(filter_rfds(rfds, ["height"], "all"))) == {"weight"}
    assert set(names(filter_rfds(rfds, ["height"], "all", rhs_excluded=False))) == {"weight", "height"}
    assert set(names(filter_rfds(rfds, ["age", "weight"], "any"))) == {"height"}
    assert set(names(filter_rfds(rfds, ["age", "weight"], "any", rhs_excluded=False))) == {"height", "weight", "age"}
    assert set(names(filter_rfds(rfds, ["age"], None))) == {"height", "weight"}
    assert names(rank_rfds(rfds, ["weight", "age"])) == ["height", "age", "weight"]
    assert names(rank_rfds(rfds, ["age"], nulls="last", by_unused=False)) == ["age", "weight", "height"]
    assert names(rank_rfds(rfds, ["age"], n=1)) == ["height"]
    assert names(rank_rfds(rfds, ["age"], n=0)) == ["height"]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_rfd_files(spark, rfds, fmt):
    path = shared_dir(spark, "rfds")
    write_rfds(rfds, path, fmt, attrs=WIDE_COLS, digits=None)
    back = read_rfds(spark, path, fmt, attrs=WIDE_COLS)
    as_set = lambda df: {(r["rfd_id"], r["rhs"], r["rhs_threshold"], tuple(sorted(r["lhs"].items()))) for r in df.collect()}
    assert as_set(back) == as_set(rfds)


def test_rfd_json_array_and_partitions(spark, rfds, tmp_path):
    file = tmp_path / "rfds.json"
    file.write_text(json.dumps([{"LHS": {"a": 1.0, "b": 0.0}, "RHS": {"c": 2.0}}]))
    row = read_rfds(spark, str(file), "json_array").first()
    assert (row["rhs"], row["rhs_threshold"], row["lhs"]) == ("c", 2.0, {"a": 1.0, "b": 0.0})
    assert Rfd.from_dict({"LHS": {"a": 1.0}, "RHS": {"c": 2.0}}).to_dict() == {"LHS": {"a": 1.0}, "RHS": {"c": 2.0}}
    path = shared_dir(spark, "parts")
    write_rfds(rfds, path, attrs=WIDE_COLS, partition_by="rhs")
    back = spark.read.option("header", True).option("sep", ";").option("nullValue", "?").csv(path)
    assert {r["rhs"] for r in back.collect()} == {"height", "weight", "age"}
    assert back.filter("rhs = 'height'").first()["key"] == '{"lhs":["weight"],"rhs":["height"]}'


def test_csv_reading(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("name;sex;age;date\ncat;male;20;2001/01/02\ndog;?;?;2001/03/02\n;female;7;?\n")
    d = sniff_csv(spark, str(f))
    assert (d.sep, d.header) == (";", True)
    df = read_table(spark, str(f), date_cols=["date"], date_format="yyyy/MM/dd", id_col="row_id")
    assert dict(df.dtypes)["age"] == "int" and dict(df.dtypes)["date"] == "timestamp"
    rows = df.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert [r["name"] for r in rows] == ["cat", "dog", None] and [r["age"] for r in rows] == [20, None, 7]
    assert rows[1]["sex"] is None and rows[2]["date"] is None and rows[0]["date"].day == 2
    assert table_profile(df.drop("row_id")).first().asDict() == {
        "n_rows": 3, "n_columns": 4, "columns": "name,sex,age,date"}
    f.write_text("B,1,1,1\nR,1,1,2\nL,1,?,3\n")
    d = sniff_csv(spark, str(f), candidates=",;|")
    assert (d.sep, d.header) == (",", False)
    assert read_table(spark, str(f)).count() == 3
    f.write_text('"1","2"\n5.1,setosa\n4.9,"se,tosa"\n')
    assert sniff_csv(spark, str(f)).header
    f.write_text("name|city\njohn|rome\nann|oslo\n")
    assert sniff_csv(spark, str(f)) == sniff_csv(spark, str(f), ",|") and sniff_csv(spark, str(f)).sep == "|"
    f.write_text("a; b\n1; x\n2; y\n")
    df = read_table(spark, str(f), sep=";", header=True, skip_blanks=True)
    assert df.columns == ["a", "b"] and {r["b"] for r in df.collect()} == {"x", "y"}
    f.write_text("age;height\nRHS;LHS\n5;?\n3;1.5\n")
    df = read_table(spark, str(f), sep=";", header_rows=2)
    assert df.columns == ["age|RHS", "height|LHS"] and df.count() == 2
    assert columns_with_role(df, "RHS").columns == ["age|RHS"]
    df = read_table(spark, str(f), sep=";", header_rows=2, schema="a int, b double")
    assert {r["age|RHS"] for r in df.collect()} == {5, 3}
    f.write_text("a;b\nx;y\nx;y\na;b\n\nq;?\n")  # lines equal to a header further down are data
    df = read_table(spark, str(f), sep=";", header_rows=2)
    assert sorted((r[0], r[1]) for r in df.collect() if r[1]) == [("a", "b"), ("x", "y")] and df.count() == 3


def test_csv_round_trip(spark):
    df = spark.sql("select 1 as i, cast(null as string) as s, date'2020-01-05' as d union all select 2, 'x', null")
    path = shared_dir(spark, "csv")
    write_table(df, path, date_format="yyyy/MM/dd")
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "1;?;2020/01/05" in text and "2;x;?" in text
    back = read_table(spark, path, sep=";", header=True, date_cols=["d"], date_format="yyyy/MM/dd")
    assert back.filter("i = 1").first()["s"] is None and back.filter("i = 1").first()["d"].day == 5


def test_dense_row_ids(spark):
    df = with_row_id(spark.range(0, 1000, 1, 7).filter("id % 3 = 0"), "n")
    assert sorted(r["n"] for r in df.collect()) == list(range(334))
    assert [r["id"] for r in df.orderBy("n").collect()] == list(range(0, 1000, 3))


def rows_of(seed, n=40):
    rng = random.Random(seed)
    return [(i * 3, rng.randint(0, 6), rng.choice(["ab", "abc", "xyz", None]), rng.randint(0, 9) / 2) for i in range(n)]


@pytest.mark.parametrize("lhs,rhs,t", [({"a": 1.0}, "y", 1.0), ({"a": 0.0, "s": 1.0}, "y", 0.5), ({"y": 0.5}, "s", 0.0)])
def test_checks(spark, lhs, rhs, t):
    rows = rows_of(1) + [(1000, 3, "ab", 1.0), (1001, 3, "ab", 1.0)]
    df = spark.createDataFrame(rows, "id int, a int, s string, y double")
    pos = {"a": 1, "s": 2, "y": 3}
    rfd = Rfd(lhs, rhs, t, "r")
    near = lambda r, q, th: all(brute.gap(r[pos[c]], q[pos[c]]) <= x for c, x in th.items())
    bad = [(r, q) for r, q in itertools.combinations(rows, 2) if near(r, q, lhs) and not near(r, q, {rhs: t})]
    got = rfd_violations(df, rfd, "id").collect()
    assert sum(r["n_pairs"] for r in got) == len(bad)
    assert {r["distance"] for r in got} == {brute.gap(r[pos[rhs]], q[pos[rhs]]) for r, q in bad}
    loose = Rfd(lhs, rhs, brute.INF, "loose")
    held = {r["rfd_id"]: r["holds"] for r in rfd_holds(df, [rfd, loose], "id").collect()}
    assert held == {"r": not bad, "loose": True}
    nodes = {r["node"]: r["weight"] for r in rfd_nodes(df, rfd, "id").collect()}
    assert sum(nodes.values()) == len(rows)
    by_id = {r[0]: r for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(nodes), 2)
            if near(by_id[a], by_id[b], rfd.thresholds())}
    assert {tuple(r) for r in rfd_edges(df, rfd, "id").collect()} == want


@pytest.mark.parametrize("seed,limit", [(1, 192), (2, 192), (3, 2), (4, 0)])
def test_max_clique(spark, monkeypatch, seed, limit):
    import nearfd.operators.extent as extent
    monkeypatch.setattr(extent, "TASK_NODES", limit)
    rng = random.Random(seed)
    weights = {i * 7 % 101: rng.randint(1, 3) for i in range(12)}
    edges = [e for e in itertools.combinations(sorted(weights), 2) if rng.random() < 0.55]
    nodes = spark.createDataFrame(list(weights.items()), "node long, weight long")
    got = max_clique(nodes, spark.createDataFrame(edges, "src long, dst long")).first()
    assert (got["weight"], list(got["clique"])) == brute.max_clique(weights, edges)


def test_extent(spark):
    rows = rows_of(3, 30) + [(1000 + i, 3, "ab", 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, a int, s string, y double")
    rfd = Rfd({"a": 2.0}, "y", 1.0)
    nodes = {}
    for r in rows:
        nodes.setdefault((r[1], r[3]), []).append(r[0])
    rep = {min(v): (k, v) for k, v in nodes.items()}
    edges = [(p, q) for p, q in itertools.combinations(sorted(rep), 2)
             if abs(rep[p][0][0] - rep[q][0][0]) <= 2 and abs(rep[p][0][1] - rep[q][0][1]) <= 1]
    import networkless
    best = networkless.heaviest({p: len(rep[p][1]) for p in rep}, edges)
    want = sorted(i for p in best for i in rep[p][1])
    assert sorted(r["id"] for r in rfd_extent(df, rfd, "id").collect()) == want


def test_taxonomy(spark):
    taxonomy = spark.createDataFrame(
        [("cat", "mammal"), ("dog", "mammal"), ("mammal", "animal"), ("fish", "animal"), ("x", "y"), ("y", "x")],
        ["child", "parent"])
    lexicon = spark.createDataFrame([(t, t) for t in ("cat", "dog", "fish", "animal", "x")], ["term", "node"])
    pairs = spark.createDataFrame([("cat", "cat"), ("cat", "dog"), ("cat", "fish"), ("cat", "animal"), ("cat", "x"),
                                   ("cat", "unknown")], ["left", "right"])
    got = {r["right"]: r["distance"] for r in taxonomy_distance(pairs, lexicon, taxonomy).collect()}
    assert got["unknown"] is None and got["x"] == 1.0 and got["cat"] == 0.0
    assert got["dog"] == pytest.approx(2 / 3) and got["fish"] == pytest.approx(3 / 4)
    assert got["animal"] == pytest.approx(2 / 3)
    steps = {(r["node"], r["ancestor"]): r["steps"] for r in ancestors(lexicon, taxonomy).collect()}
    assert steps[("cat", "animal")] == 2 and steps[("x", "y")] == 1


def test_taxonomy_pairs_in_joins_and_relaxation(spark):
    from nearfd import extend_query, relax_columns, relax_rows, similarity_join, taxonomy_pairs
    taxonomy = spark.createDataFrame([("cat", "mammal"), ("dog", "mammal"), ("mammal", "animal"), ("fish", "animal")],
                                     ["child", "parent"])
    lexicon = spark.createDataFrame([(t, t) for t in ("cat", "dog", "fish")], ["term", "node"])
    df = spark.createDataFrame([(1, "cat", 1), (2, "dog", 1), (3, "fish", 1), (4, "stone", 1), (5, None, 1), (6, "dog", 9)],
                               "id int, kind string, n int")
    near = taxonomy_pairs(df.select("kind"), df.select("kind"), lexicon, taxonomy, 0.67)
    words = ["cat", "dog", "fish", "stone"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], ["left", "right"])
    want = {(r["left"], r["right"]) for r in taxonomy_distance(pairs, lexicon, taxonomy).collect()
            if r["left"] == r["right"] or (r["distance"] is not None and r["distance"] <= 0.67)}
    assert {tuple(r) for r in near.collect()} == want and ("cat", "dog") in want and ("cat", "fish") not in want
    ids = lambda d: sorted(r["id"] for r in d.collect())
    answers = df.filter("id = 1 or id = 5")
    rfd = Rfd({"n": 1.0}, "kind", 0.67)
    assert ids(relax_rows(df, answers, rfd, metrics={"kind": near})) == [1, 2, 5]
    assert ids(relax_columns(df, answers, rfd, metrics={"kind": near})) == [1, 2, 5]
    assert ids(similarity_join(df, answers, {"kind": (near, 0.67)}, "left_anti")) == [3, 4]
    spec = QuerySpec([("kind", "=", "cat")])
    assert ids(extend_query(spec, rfd, df, metrics={"kind": near}).apply(df)) == [1, 2, 6]


def test_measured_discovery(spark, tmp_path):
    from nearfd import measure_discovery
    f = tmp_path / "t.csv"
    f.write_text("a;b;c\n1;2;x\n2;3;xy\n4;4;z\n9;1;?\n")
    runs = measure_discovery(spark, str(f), "t").collect()
    assert len(runs) == 3 and all(r["ds_len"] == 4 and r["ds_attr_size"] == 3 for r in runs)
    assert runs[0]["ds_file_size_B"] == f.stat().st_size
    assert runs[0]["attr_comb"] == '{"rhs": ["a"], "lhs": ["b", "c"]}'


def test_dominates(spark):
    df = spark.sql("select 1.0d as a, 2.0d as b, 1.0d as c, 3.0d as d, cast(null as double) as n")
    c = F.col
    row = df.select(dominates([c("b"), c("d")], [c("a"), c("c")]).alias("yes"),
                    dominates([c("a"), c("d")], [c("b"), c("c")]).alias("no"),
                    dominates([c("n"), c("d")], [c("b"), c("c")]).alias("unused")).first()
    assert row["yes"] and not row["no"] and row["unused"]


def test_run_metrics(spark):
    runs = bench_results(spark, [{"ds_name": "a", "time_elapsed": 1.5, "rfd_count": 3},
                                 {"ds_name": "a", "time_elapsed": 2.5, "rfd_count": 5}])
    assert bench_summary(runs, "ds_name", ["time_elapsed", "rfd_count"]).first().asDict() == {
        "ds_name": "a", "time_elapsed": 2.0, "rfd_count": 4.0}
    path = shared_dir(spark, "runs")
    append_results(runs, path)
    append_results(runs, path)
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert sum("1,5" in line for line in text) == 2


def test_row_ids_after_a_sort_with_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        df = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
        out = with_row_id(df.orderBy("k"), "n")
        n, ids, low, high = out.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
        assert (n, ids, low, high) == (300_000, 300_000, 0, 299_999)
        assert out.join(out.select((F.col("n") + 1).alias("n"), F.col("k").alias("last")), "n").filter("last > k").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_taxonomy_has_no_depth_limit(spark):
    chain = spark.range(60).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent"))
    terms = spark.createDataFrame([("x", "0"), ("y", "60")], "term string, node string")
    pair = spark.createDataFrame([("x", "y")], "left string, right string")
    assert round(taxonomy_distance(pair, terms, chain).first().distance, 6) == 0.983607


def test_extent_of_text_ids(spark):
    rows = [("r10", 1, 1), ("r2", 1, 1), ("x", 1, 9), ("y", 2, 2)]
    df = spark.createDataFrame(rows, "id string, a int, b int")
    assert {r["id"] for r in rfd_extent(df, Rfd({"a": 0.0}, "b", 0.0), "id").collect()} == {"r10", "r2"}  # within all thresholds


def test_not_a_number_counts_as_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0), (4, float("nan"))], "id int, x double")
    got = {(r["id_a"], r["id_b"]): r["x"] for r in pair_distances(df, ["x"], id_col="id", distinct=False).collect()}
    inf = float("inf")
    assert got == {(1, 2): 0.0, (1, 3): inf, (1, 4): 0.0, (2, 3): inf, (2, 4): 0.0, (3, 4): inf}


@pytest.mark.parametrize("seed,piece", [(1, 512), (2, 4), (3, 1), (4, 7)])
def test_boxes_equal_cliques(spark, monkeypatch, seed, piece):
    """Sweeping boxes and the maximum clique over all pairs name the same rows, ties included."""
    import nearfd.operators.extent as extent
    from nearfd.operators.check import rfd_nodes as nodes_of

    monkeypatch.setattr(extent, "PIECE", piece)
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(i, rng.randint(0, 12), rng.choice(odd) if rng.random() < 0.2 else rng.randint(0, 40) / 4, rng.choice(["a", "b", None]),
             rng.choice([None, *range(9)])) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, a int, x double, s string, k int").withColumn(
        "day", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, k, (id * 7) % 24)")).drop("k")
    for rfd in (Rfd({"a": 5.0}, "x", 4.0), Rfd({"x": 3.25}, "day", 3.0), Rfd({"a": 6.0, "x": 5.0}, "day", 4.0), Rfd({"s": 0.0}, "x", 2.0),
                Rfd({"a": float("inf")}, "x", 0.0), Rfd({"a": float("inf")}, "s", 0.0)):
        nodes = nodes_of(df, rfd, "id").cache()
        want = max_clique(nodes, rfd_edges(df, rfd, "id", None, nodes)).first()
        chosen = set(want["clique"])
        ids = {r["id"] for r in extent.node_members(df, nodes, rfd, "id").collect() if r["node"] in chosen}
        got = {r["id"] for r in rfd_extent(df, rfd, "id").collect()}
        assert got == ids, rfd


def test_wide_boxes_need_no_edges(spark, monkeypatch):
    import nearfd.operators.extent as extent

    monkeypatch.setattr(extent, "rfd_edges", None)
    df = spark.range(3000).selectExpr("id", "id % 97 as a", "id * 37 % 1009 as b")
    got = {r["id"] for r in rfd_extent(df, Rfd({"a": 48.0}, "b", 504.0), "id").collect()}
    rows = [(i % 97, i * 37 % 1009) for i in range(3000)]
    best = max(sum(x <= a <= x + 48 and y <= b <= y + 504 for a, b in rows) for x in range(97) for y in range(0, 1009, 1)
               if x <= 48 and y <= 504)
    assert len(got) == best


def test_forest_distances_equal_ancestor_sets(spark, monkeypatch):
    import nearfd.operators.taxonomy as X

    rng = random.Random(5)
    edges = [(f"n{i}", f"n{rng.randint(max(0, i - 6), i - 1)}") for i in range(1, 60) if i not in (20, 41)] + [("n3", "n3")]
    taxonomy = spark.createDataFrame(edges, "child string, parent string")
    terms = [f"n{i}" for i in range(62)]
    lexicon = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(terms)], "term string, node string")
    pairs = spark.createDataFrame([(f"t{rng.randint(0, 63)}", f"t{rng.randint(0, 63)}") for _ in range(300)], "left string, right string")
    forest = sorted(tuple(r) for r in taxonomy_distance(pairs, lexicon, taxonomy).collect() if r.distance is not None)
    jumps, depths = X.forest_jumps(taxonomy)
    assert 2 <= len(jumps) <= 6 and max(r.depth for r in depths.collect()) >= 8
    monkeypatch.setattr(X, "forest_jumps", lambda t: None)
    sets = sorted(tuple(r) for r in taxonomy_distance(pairs, lexicon, taxonomy).collect() if r.distance is not None)
    assert [r[:2] for r in forest] == [r[:2] for r in sets] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(forest, sets))
    assert X.forest_paths(spark.createDataFrame([], "a string, b string"), jumps, depths).count() == 0


def test_long_chains_take_few_rounds(spark):
    import nearfd.operators.taxonomy as X

    n = 5000
    taxonomy = spark.range(n).selectExpr("concat('n', id) AS child", "concat('n', id + 1) AS parent")
    lexicon = spark.range(n + 1).selectExpr("concat('n', id) AS term", "concat('n', id) AS node")
    jumps, depths = X.forest_jumps(taxonomy)
    assert len(jumps) <= 14 and depths.filter("root <> 'n5000'").isEmpty() and depths.agg({"depth": "max"}).first()[0] == n
    assert X.forest_jumps(taxonomy.union(spark.sql("SELECT 'n5000', 'n7'"))) is None  # a cycle
    assert X.forest_jumps(taxonomy.union(spark.sql("SELECT 'n1', 'n7'"))) is None  # two parents
    pairs = spark.createDataFrame([("n0", "n5000"), ("n4999", "n17"), ("n5", "n5"), ("n5", "zz")], "left string, right string")
    got = {(r.left, r.right): r.distance for r in taxonomy_distance(pairs, lexicon, taxonomy).collect()}
    assert got == {("n0", "n5000"): 1 - 1 / 5001, ("n4999", "n17"): 1 - 1 / 4983, ("n5", "n5"): 0.0, ("n5", "zz"): None}
