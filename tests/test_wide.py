"""Tables of 20 and more columns, packed vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import nearfd.operators.pairs as P
from nearfd import discover_all, pair_distances
from nearfd.operators.packed import edit_distances, first_rows


def wide_rows(n, seed=1, unknown=0.1):
    """Rows of the kind of clinical tables: small whole numbers, fractions, words, dates, many unknown."""
    rng = random.Random(seed)
    some = [lambda: rng.randint(0, 3), lambda: rng.randint(0, 90), lambda: round(rng.random() * 10, 2),
            lambda: rng.choice(["no", "yes", "é漢", "", "maybe"]), lambda: float("nan") if rng.random() < 0.05 else float(rng.randint(0, 5))]
    return [tuple(None if rng.random() < unknown else some[c % 5]() for c in range(20)) for _ in range(n)]


KIND = ", ".join(f"c{c} {('int', 'long', 'double', 'string', 'double')[c % 5]}" for c in range(20))


def known(v):
    return None if isinstance(v, float) and v != v else v


def test_wide_pairs_equal_brute_force(spark):
    rows = wide_rows(40) + wide_rows(3)
    df = spark.createDataFrame(rows, KIND)
    got = pair_distances(df)
    assert got.columns == df.columns and "applyInArrow" not in got.columns
    assert {tuple(r) for r in got.collect()} == brute.vectors([tuple(map(known, r)) for r in rows])


def test_packed_and_plain_agree(spark, monkeypatch):
    rows = [(i, *r) for i, r in enumerate(wide_rows(25, 3))]
    df = spark.createDataFrame(rows, "id int, " + KIND).select("id", *[f"c{c}" for c in range(6)]).withColumn(
        "day", F.expr("timestamp'2020-02-27 12:00:00' + make_interval(0, 0, 0, id % 7, id)")).withColumn("odd.name", F.expr("nullif(id % 3, 1)"))
    attrs = df.columns[1:]
    plain = [sorted(map(tuple, pair_distances(df, attrs, "id", **k).collect())) for k in ({}, {"distinct": False}, {"ordered": True})]
    monkeypatch.setattr(P, "WIDE", 0)
    packed = [sorted(map(tuple, pair_distances(df, attrs, "id", **k).collect())) for k in ({}, {"distinct": False}, {"ordered": True})]
    assert packed == plain and len(packed[1]) == 300 and len(packed[2]) == 625
    by_blocks = pair_distances(df, attrs, "id", distinct=False, blocks=7)
    assert sorted(map(tuple, by_blocks.collect())) == plain[1]


@pytest.mark.parametrize("columns", [20, 28])
def test_wide_tables_are_discovered(spark, columns):
    """Shapes of tables with 20 and 28 columns: they plan, finish, and every dependency holds."""
    rng = random.Random(columns)
    rows = [tuple(None if rng.random() < 0.2 else rng.randint(0, 2 + c % 4) for c in range(columns)) for _ in range(14)]
    names = [f"a{c}" for c in range(columns)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    vecs = brute.vectors(rows)
    assert {tuple(r) for r in pair_distances(df).collect()} == vecs
    found = discover_all(df).collect()
    assert found
    for r in found:
        assert brute.holds(vecs, names.index(r.rhs), r.rhs_threshold, {names.index(c): t for c, t in r.lhs.items()})


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], KIND)
    assert pair_distances(df).count() == 0
    one = spark.createDataFrame(wide_rows(1), KIND)
    assert pair_distances(one).count() == 0
    assert [set(r) for r in pair_distances(one.union(one)).collect()] == [{0.0}]


def test_edit_distances_side_by_side():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé漢😀") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    a, b = np.array(words[:150], dtype=object), np.array(words[150:], dtype=object)
    assert edit_distances(a, b).tolist() == [brute.edit(x, y) for x, y in zip(a, b)]


def test_first_rows_hold_every_row():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (500, 4)).astype(float)
    assert {tuple(r) for r in m[first_rows(m)]} == {tuple(r) for r in m}
