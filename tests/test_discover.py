import random

import pytest
from pyspark.sql import functions as F

import brute
from nearfd import (discover, discover_all, distance_medians, pair_distances, rfd_holds, first_rfds,
                    skyline, split_sides, side_combinations, Rfd)
from nearfd.plans import blocks
from nearfd.operators import discover as discover_module

# fixed values
NUMERIC = [(175, 70, 40, 30), (175, 75, 39, 41), (175, 69, 40, 33), (176, 71, 40, 35),
           (178, 81, 41, 27), (169, 73, 38, 49), (170, 65, 39, 30)]
NUMERIC_COLS = ["height", "weight", "shoe_size", "age"]
# (rhs, age, height, shoe_size, weight)
# fixed values
NUMERIC_RFDS = """height;?;1.0;?;1.0
height;2.0;1.0;0.0;2.0
height;5.0;1.0;0.0;?
height;?;1.0;0.0;2.0
height;3.0;0.0;0.0;1.0
weight;0.0;?;?;5.0
weight;6.0;1.0;?;4.0
weight;2.0;1.0;0.0;2.0
weight;?;1.0;0.0;2.0
weight;2.0;?;0.0;2.0
weight;?;0.0;0.0;1.0
weight;3.0;0.0;0.0;1.0
shoe_size;6.0;1.0;1.0;?
shoe_size;?;6.0;1.0;2.0
shoe_size;?;5.0;1.0;5.0
shoe_size;11.0;?;1.0;5.0
shoe_size;0.0;?;1.0;?
shoe_size;?;0.0;1.0;?
shoe_size;3.0;5.0;1.0;?
shoe_size;?;1.0;1.0;4.0
shoe_size;8.0;?;1.0;2.0
shoe_size;3.0;3.0;1.0;11.0
shoe_size;3.0;5.0;1.0;4.0
shoe_size;6.0;1.0;1.0;4.0
shoe_size;8.0;6.0;1.0;2.0
shoe_size;3.0;?;1.0;4.0
shoe_size;3.0;3.0;1.0;?
shoe_size;8.0;?;1.0;6.0
shoe_size;3.0;0.0;0.0;?
shoe_size;2.0;1.0;0.0;2.0
shoe_size;?;?;0.0;1.0
shoe_size;?;1.0;0.0;2.0
shoe_size;2.0;?;0.0;2.0
age;8.0;6.0;1.0;2.0
age;8.0;?;1.0;2.0
age;6.0;1.0;?;4.0
age;5.0;1.0;0.0;?
age;5.0;?;?;1.0
age;3.0;0.0;0.0;1.0"""

# fixed values
PEOPLE = [("john", "male", "newyork", 20), ("jack", "male", "newyork", 21),
          ("mary", "female", "losangeles", 45), ("maryanne", "female", "losangeles", 48),
          ("eric", "male", "san francisco", 26), ("jenny", "female", "boston2", 30),
          ("mattia", "na", "BostonDynamics", 50), ("gianna", "male", "avellino", 48)]
PEOPLE_COLS = ["name", "sex", "city", "age"]
# (rhs, age, city, name, sex)
# fixed values
PEOPLE_RFDS = """name;?;7.0;5.0;?
name;0.0;?;5.0;?
name;?;0.0;4.0;?
name;3.0;?;4.0;0.0
name;1.0;0.0;3.0;0.0
sex;1.0;?;?;0.0
sex;?;?;3.0;0.0
sex;?;0.0;?;0.0
city;?;10.0;3.0;?
city;0.0;9.0;?;?
city;10.0;6.0;3.0;0.67
city;1.0;0.0;3.0;0.0
city;?;0.0;3.0;0.0
age;18.0;7.0;4.0;?
age;15.0;?;4.0;0.0
age;10.0;6.0;?;?
age;3.0;0.0;?;?
age;1.0;0.0;3.0;0.0"""

MORE_PEOPLE = PEOPLE + [("domenica", "female", "newyork", 22), ("domenico", "male", "newyork", 21)]
# fixed values
MORE_PEOPLE_RFDS = """sex;0.0;?;?;0.0
sex;?;?;3.0;0.0
sex;?;0.0;?;0.0
city;?;10.0;3.0;?
city;0.0;9.0;?;?
city;10.0;6.0;3.0;0.67
city;1.0;0.0;3.0;0.0
city;?;0.0;1.0;?
city;0.0;0.0;?;0.0
city;?;0.0;3.0;0.0
age;18.0;7.0;4.0;?
age;15.0;?;4.0;0.0
age;10.0;6.0;?;?
age;8.0;6.0;?;0.0
age;3.0;0.0;?;?
age;1.0;?;1.0;?
age;1.0;0.0;3.0;0.0"""


def table(text):
    rows = [line.split(";") for line in text.splitlines()]
    return {(r[0], *(None if v == "?" else float(v) for v in r[1:])) for r in rows}


def wide(rows, cols, digits=2):
    out = set()
    for r in rows:
        thr = {**r["lhs"], r["rhs"]: r["rhs_threshold"]}
        out.add((r["rhs"], *(round(thr[c], digits) if c in thr else None for c in cols)))
    return out


def test_numeric_golden(spark):
    df = spark.createDataFrame(NUMERIC, NUMERIC_COLS)
    assert pair_distances(df).count() == 21
    got = discover_all(df).collect()
    assert wide(got, ["age", "height", "shoe_size", "weight"]) == table(NUMERIC_RFDS)
    assert len({r["rfd_id"] for r in got}) == len(got) == 39


def sex_gap(a, b):
    other = F.when((a == "na") | (b == "na"), 0.9).otherwise(2 / 3)
    return F.when(a == b, 0.0).otherwise(other)


@pytest.mark.parametrize("rows,want", [(PEOPLE, PEOPLE_RFDS), (MORE_PEOPLE, MORE_PEOPLE_RFDS)])
def test_string_goldens_in_compatible_mode(spark, rows, want):
    df = spark.createDataFrame(rows, PEOPLE_COLS)
    got = discover_all(df, metrics={"sex": sex_gap}, compat_int_rhs=True).collect()
    assert wide(got, ["age", "city", "name", "sex"]) == table(want)


def test_taxonomy_metric_gives_the_same_distances(spark):
    df = spark.createDataFrame(PEOPLE, PEOPLE_COLS).filter("sex <> 'na'")
    lexicon = spark.createDataFrame([("male", "m"), ("female", "f")], ["term", "node"])
    taxonomy = spark.createDataFrame([("m", "person"), ("f", "person")], ["child", "parent"])
    from nearfd import choose_metrics
    assert choose_metrics(df, lexicon=lexicon)["sex"] == "taxonomy"
    assert choose_metrics(df, lexicon=lexicon.filter("term = 'male'"))["sex"] == "edit"
    got = pair_distances(df, lexicon=lexicon, taxonomy=taxonomy).collect()
    assert {r["sex"] for r in got} == {0.0, round(2 / 3, 6)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tables_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "abc", "bcd", "xyz", "xy", None]
    rows = [(rng.choice([None, 1, 2, 3, 5, 9]), rng.randint(0, 12) / 4, rng.choice(words), rng.randint(0, 30))
            for _ in range(28)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d int")
    pairs = pair_distances(df)
    vecs = brute.vectors(rows)
    assert {tuple(r) for r in pairs.collect()} == vecs
    meds = {r["attr"]: r["median"] for r in distance_medians(pairs).collect()}
    assert meds == {c: brute.median([v[i] for v in vecs]) for i, c in enumerate("abcd")}
    for compat in (False, True):
        got = discover(pairs, compat_int_rhs=compat).collect()
        for i, c in enumerate("abcd"):
            left = [x for x in "abcd" if x != c]
            mine = {(r["rhs_threshold"], tuple(r["lhs"].get(x) for x in left)) for r in got if r["rhs"] == c}
            assert mine == brute.discover(vecs, i, compat)
            if not compat:
                for beta, thr in mine:
                    lhs = {"abcd".index(x): t for x, t in zip(left, thr, strict=True) if t is not None}
                    assert brute.holds(vecs, i, beta, lhs)


def test_many_blocks_and_buckets_give_the_same_result(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 1000)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    want = {tuple(sorted(r.asDict(True)["lhs"].items())) + (r["rhs"], r["rhs_threshold"])
            for r in discover_all(df).collect()}
    import nearfd.operators.discover as d
    monkeypatch.setattr(d, "SMALL", 0)
    monkeypatch.setattr(d, "DOMINANCE_ROWS", 7)
    monkeypatch.setattr(d, "CELL", 5)
    got = {tuple(sorted(r.asDict(True)["lhs"].items())) + (r["rhs"], r["rhs_threshold"])
           for r in d.discover_all(df).collect()}
    assert got == want


def test_one_right_side_and_chosen_left(spark):
    df = spark.createDataFrame(NUMERIC, NUMERIC_COLS)
    pairs = pair_distances(df)
    every = {(r["rhs"], tuple(sorted(r["lhs"].items())), r["rhs_threshold"]) for r in discover(pairs).collect()}
    one = {(r["rhs"], tuple(sorted(r["lhs"].items())), r["rhs_threshold"]) for r in discover(pairs, "age").collect()}
    assert one == {e for e in every if e[0] == "age"}
    two = discover(pairs, "age", ["height", "weight"]).collect()
    vecs = [tuple(r) for r in pairs.select("age", "height", "weight").collect()]
    assert {(r["rhs_threshold"], (r["lhs"].get("height"), r["lhs"].get("weight"))) for r in two} == \
        brute.discover(set(vecs), 0)


def test_sides():
    assert side_combinations(["a", "b"]) == [("a", ["b"]), ("b", ["a"])]
    assert side_combinations(["a", "b", "c"], "b") == [("b", ["a", "c"])]
    assert side_combinations(["a", "b", "c"], "b", ["c"]) == [("b", ["c"])]
    for bad in ((None, ["a"]), ("z", None), ("a", ["a"]), ("a", ["b", "b"])):
        with pytest.raises(ValueError):
            side_combinations(["a", "b", "c"], *bad)


def test_custom_algorithm(spark):
    pairs = pair_distances(spark.createDataFrame(NUMERIC, NUMERIC_COLS))
    from nearfd import make_rfds

    def nothing(frame):
        assert frame.columns[0] == "RHS"
        return make_rfds(frame.limit(1).select(F.lit("x").alias("rhs"), F.lit(1.0).alias("rhs_threshold"),
                                               F.create_map(F.lit("y"), F.lit(2.0)).alias("lhs")))

    assert discover(pairs, algorithm=nothing).count() == 4


def test_pairs_of_rows(spark):
    rows = [(1, "a", 1), (2, "ab", 1), (3, None, 4), (4, "ab", 1)]
    df = spark.createDataFrame(rows, "id int, s string, n int")
    got = pair_distances(df, id_col="id", distinct=False).collect()
    assert len(got) == 6 and all(r["id_a"] < r["id_b"] for r in got)
    ordered = pair_distances(df, id_col="id", ordered=True).collect()
    assert len(ordered) == 16
    d = {(r["id_a"], r["id_b"]): (r["s"], r["n"]) for r in ordered}
    assert d[(1, 2)] == d[(2, 1)] == (1.0, 0.0) and d[(3, 3)] == (0.0, 0.0)
    assert d[(1, 3)] == (brute.INF, 3.0)
    assert {tuple(r) for r in pair_distances(df, ["s", "n"]).collect()} == brute.vectors([r[1:] for r in rows])


def test_pairs_plan_has_no_cartesian_product(spark):
    df = spark.range(5000).selectExpr("id % 97 as a", "id as b")
    plan = pair_distances(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_distance_tables_of_short_dictionaries(spark, monkeypatch):
    import nearfd.operators.pairs as p
    monkeypatch.setattr(p, "DICTIONARY_ROWS", 0)
    monkeypatch.setattr(p, "DICTIONARY", 5)
    rng = random.Random(11)
    rows = [(rng.choice(["a,b", "abc", "it's", None]), f"v{rng.randint(0, 40)}", rng.randint(0, 3)) for _ in range(40)]
    df = spark.createDataFrame(rows, "few string, many string, n int")
    assert set(p._edit_tables(df, ["few", "many"])) == {"few"}
    assert {tuple(r) for r in pair_distances(df).collect()} == brute.vectors(rows)


def test_dates_and_bad_types(spark):
    df = spark.sql("select * from values (timestamp'2001-01-02 00:00:00'), (timestamp'2001-01-03 23:00:00'),"
                   "(timestamp'2001-01-01 12:00:00') as t(d)")
    assert {r["d"] for r in pair_distances(df).collect()} == {1.0, 0.0, 2.0}
    with pytest.raises(ValueError):
        pair_distances(spark.sql("select true as b"))


@pytest.mark.parametrize("rows_per_cell", [4096, 20])
def test_skyline(spark, monkeypatch, rows_per_cell):
    import nearfd.operators.skyline as s
    monkeypatch.setattr(s, "DOMINANCE_ROWS", rows_per_cell)
    rng = random.Random(5)
    rows = [(rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    got = sorted(tuple(r) for r in skyline(df, ["x", "y"], ["z"]).collect())
    best = brute.minimal({(a, b, -c) for a, b, c in rows})
    assert got == sorted(r for r in rows if (r[0], r[1], -r[2]) in best)


def test_bounded_local_pools_stay_exact(spark):
    rng = random.Random(9)
    rows = [(float(rng.randint(0, 50)), float(rng.randint(0, 50))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double").distinct()
    near = blocks.local_minima(df, ["a", "b"], pool_rows=2)
    got = {tuple(r) for r in blocks.dominance_cells(near, ["a", "b"], None, 3).collect()}
    assert got == brute.minimal(set(rows))


def test_regions_that_cannot_reach_each_other_never_meet(spark):
    """On correlated points a region meets a few others; on any points the result stays exact."""
    rng = random.Random(3)
    base = [rng.random() for _ in range(2000)]
    rows = [(x + rng.random() / 50, x + rng.random() / 50, rng.random()) for x in base]
    df = spark.createDataFrame(rows, "a double, b double, r double")
    placed = blocks.with_regions(df, ["a", "b"], None, 25)
    sizes = [r["count"] for r in placed.groupBy("_region").count().collect()]
    assert max(sizes) <= 25 and sum(sizes) == 2000 and len(sizes) >= 80
    met = blocks.region_pairs(placed, ["a", "b"], None, None).collect()
    assert sum(len(r.others) for r in met) < 10 * len(sizes) < len(sizes) ** 2 / 4
    assert len(met) < len(sizes) / 2  # whole regions are dominated before any point is looked at
    best = {tuple(r) for r in blocks.dominance_cells(df.select("a", "b"), ["a", "b"], None, 25).collect()}
    assert best == brute.minimal({r[:2] for r in rows})
    got = {(r.a, r.b): r.reach for r in blocks.dominance_cells(df, ["a", "b"], None, 25, value="r").collect()}
    want = {}
    for a, b, r in rows:
        reach = max((z for x, y, z in rows if x <= a and y <= b and (x, y) != (a, b)), default=-float("inf"))
        if reach < r:
            want[(a, b)] = reach
    assert got == want


def test_regions_have_one_key_and_many_packs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CORNERS", 4)
    rng = random.Random(6)
    rows = list({(rng.randint(0, 2), float(rng.randint(0, 20)), float(rng.randint(0, 20))) for _ in range(600)})
    df = spark.createDataFrame(rows, "side int, a double, b double")
    got = {tuple(r) for r in blocks.dominance_cells(df, ["a", "b"], "side", 16).collect()}
    want = {(s, *p) for s in range(3) for p in brute.minimal({r[1:] for r in rows if r[0] == s})}
    assert got == want


def test_split_sides(spark):
    pairs = pair_distances(spark.createDataFrame(NUMERIC, NUMERIC_COLS))
    assert split_sides(pairs, "age").columns == ["RHS", "height", "weight", "shoe_size"]


def test_sketched_medians_of_parts(spark, tmp_path):
    """Parts are sketched once and merged; appended pairs need no look at old ones."""
    from nearfd import median_sketches, sketch_error, sketched_medians

    df = spark.range(40_000).selectExpr("id", "cast(pmod(xxhash64(id), 5000) as double) AS a",
                                        "CASE WHEN id % 9 = 0 THEN double('inf') ELSE cast(id as double) END AS b").drop("id")
    path = str(tmp_path / "sketches")
    for i, part in enumerate(df.randomSplit([0.7, 0.2, 0.1], 3)):
        median_sketches(part, f"p{i}").write.mode("append").parquet(path)
    median_sketches(df.limit(0), "none").write.mode("append").parquet(path)
    got = {r.attr: (r.n, r.median) for r in sketched_medians(spark.read.parquet(path)).collect()}
    exact = {r.attr: r.median for r in distance_medians(df).collect()}
    for c in "ab":
        assert got[c][0] == 40_000
        lo, hi = df.agg(F.avg((F.col(c) < got[c][1]).cast("int")), F.avg((F.col(c) <= got[c][1]).cast("int"))).first()
        assert lo - sketch_error() <= 0.5 <= hi + sketch_error() and abs(got[c][1] - exact[c]) < 0.03 * exact[c]
