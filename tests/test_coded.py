import random

import brute
import pytest

from nearfd import pair_distances
from nearfd.operators import coded

INF = float("inf")


def odd_rows(n: int = 150):
    rng = random.Random(4)
    return [(rng.choice(["", "é😀", "a\0", None, f"Name#{rng.randint(0, 999):04}"]), rng.choice([None, rng.randint(-3, 9)]),
             rng.choice([None, INF, -INF, rng.randint(-999, 999) / 100, rng.randint(0, 9) + 1e-6])) for _ in range(n)]


@pytest.mark.parametrize("slots,a_group", [(1 << 26, 8), (4, 1), (1 << 26, 1)])
def test_coded_vectors_equal_brute_force(spark, monkeypatch, slots, a_group):
    monkeypatch.setattr(coded, "SLOTS", slots)
    monkeypatch.setattr(coded, "GROUP_CELLS", a_group)
    monkeypatch.setattr(coded, "SLICE_PAIRS", 40)
    rows = odd_rows()
    df = spark.createDataFrame(rows + rows[:1], "s string, n int, x double")
    tuples = df.groupBy("s", "n", "x").count().selectExpr("s", "n", "x", "count > 1 as _copies")
    got = coded.coded_distances(df, ["s", "n", "x"], {"s": "edit", "n": "abs", "x": "abs"}, blocks=9, rows=tuples)
    want = brute.vectors(rows + rows[:1], {2: lambda x, y: 0.0 if x == y else INF if None in (x, y) else brute.gap(x, y)})
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_numbers_off_the_grid_keep_the_other_plan(spark):
    rows = [(x,) for x in (0.1234567, 1 / 3, 2.5, 7e300)]
    df = spark.createDataFrame(rows, "x double")
    assert coded.coded_distances(df, ["x"], {"x": "abs"}, rows=df.selectExpr("x", "false as _copies")) is None
    assert {tuple(r) for r in pair_distances(df).collect()} == brute.vectors(rows)


def test_pairs_are_not_rows_of_a_shuffle(spark):
    """Pairs were joined and made distinct as rows; now one row per written run of vectors leaves the cells."""
    df = spark.range(600).selectExpr("concat('name', id) as s", "cast(id * 7 % 501 as double) / 100 as x")
    plan = pair_distances(df)._jdf.queryExecution().executedPlan().toString().lower()
    assert "levenshtein" not in plan and "exchange" not in plan


def test_edit_table():
    rng = random.Random(2)
    for _ in range(60):
        one, two = (sorted({"lead" + "".join(rng.choice("ab\0é😀") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))}) for _ in range(2))
        for x, line in zip(one, coded.edit_table(one, two), strict=True):
            assert line.tolist() == [brute_edit(x, y) for y in two]


def brute_edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]
