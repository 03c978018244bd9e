import math
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import brute
import numpy as np
import pyarrow as pa
import pytest

from nearfd import discover, pair_distances
from nearfd.operators import bands, coded
from nearfd.session import Later

INF = float("inf")


def odd_rows(n: int = 90):
    rng = random.Random(4)
    return [(rng.choice(["", "é😀", "a\0", None, f"Name#{rng.randint(0, 999):04}"]), rng.choice([None, rng.randint(-3, 9)]),
             rng.choice([None, INF, -INF, float("nan"), rng.randint(-999, 999) / 100, rng.randint(0, 9) + 0.0]),
             rng.choice([None, datetime(2020, 1, 1) + timedelta(hours=rng.randint(0, 90))])) for _ in range(n)]


def number(x):
    return None if x is None or x != x else x


def odd_gap(x, y):
    x, y = number(x), number(y)
    if x == y:
        return 0.0
    return INF if None in (x, y) or INF in (abs(x), abs(y)) else brute.gap(x, y)


def days(x, y):
    return 0.0 if x == y else INF if None in (x, y) else float(abs(x - y) // timedelta(days=1))


LIMITS = [{}, {"PART": 300, "CHUNK": 64, "FRESH": 40, "KEPT": 50},
          {"PART": 200, "CHUNK": 64, "SLOTS": 1, "HEAVY": 1 << 40, "WORD_TABLE": 0, "CELLS": 8, "FRESH": 30, "DENSE": 4}]


def folders(spark, name: str) -> set[str]:
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {f for f in os.listdir(at) if f.startswith(name)} if os.path.isdir(at) else set()


@pytest.mark.parametrize("attrs", ["snx", "xtn", "ts"])
def test_bands_find_what_the_vectors_have(spark, monkeypatch, attrs):
    """Bands without Spark's tasks against all pairs; numbers may be null, NaN and infinite, rows may come twice."""
    every = odd_rows()
    place = ["snxt".index(c) for c in attrs]
    gaps = {i: {"x": odd_gap, "t": days}.get(c, brute.gap) for i, c in enumerate(attrs)}
    rows = [tuple(r[i] for i in place) for r in every + every[:2]]
    vectors = brute.vectors(rows, gaps)
    df = spark.createDataFrame(every + every[:2], "s string, n int, x double, t timestamp").select(*attrs)
    source = pair_distances(df).source()
    cuts = bands.band_cuts(source)
    assert len(cuts) > 1
    t, size = source.values.toArrow(), source.space[source.by].size
    sides = [(i, [j for j in range(len(attrs)) if j != i]) for i in range(len(attrs))]
    medians = [brute.median([v[i] for v in vectors]) for i in range(len(attrs))]
    for limits in LIMITS:
        for name, value in limits.items():
            monkeypatch.setattr(bands, name, value)
        for some, compat in ((cuts, False), (cuts, True), ([(0, size - 1), (size - 1, size)], True)):
            parts = pa.concat_tables([bands.band_result(t, source.space, source.by, b, source.zero, sides, True, compat) for b in some]).to_pylist()
            counts = [Counter() for _ in attrs]
            for p in parts:
                if p["attr"] is not None:
                    values, n = np.frombuffer(p["counts"], "<i8").reshape(2, -1)
                    counts[p["attr"]].update(dict(zip(bands.in_values(values, source.space[p["attr"]]).tolist(), n.tolist(), strict=True)))
            assert counts == [Counter(v[i] for v in vectors) for i in range(len(attrs))]
            for s, (r, left) in enumerate(sides):
                use = lambda x: not compat or x > medians[r] or x == math.floor(x) if x < INF else True  # noqa: B023, E731
                got = {(*[p[f"v{d}"] for d in range(len(left))], -p["r"]) for p in parts if p["side"] == s and use(p["r"])}
                want = {(*[v[c] for c in left], -v[r]) for v in vectors if use(v[r])}
                assert got <= want and brute.minimal(got) == brute.minimal(want)


def test_discovery_writes_no_vectors(spark):
    """All distance vectors were written before discovery read them; now the rows are taken band by band."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, f"Name#{i:05}", rng.randint(0, 24), rng.randint(-999, 9999) / 100) for i in range(300)],
                               "k int, s string, n int, x double")
    before = folders(spark, "vectors")
    vectors = pair_distances(df)
    some = [{"compat_int_rhs": True}, {"rhs": "k", "lhs": ["n", "x"]}]
    got = [sorted(map(repr, discover(vectors, **x).collect())) for x in some]
    assert not vectors.is_made() and folders(spark, "vectors") == before
    plain = vectors.localCheckpoint()  # made now: the other plan
    assert vectors.is_made() and len(folders(spark, "vectors")) == len(before) + 1
    assert got == [sorted(map(repr, discover(plain, **x).collect())) for x in some] and all(got)


def test_times_of_one_day_are_paired(spark):
    """Times that all lie within minutes were held in too few bits to be divided by a day."""
    df = spark.createDataFrame([(datetime(2020, 1, 1, 0, i), i) for i in range(9)] + [(None, 3)], "t timestamp, n int")
    got = {tuple(r) for r in pair_distances(df).collect()}
    assert got == {(0.0, float(i)) for i in range(1, 9)} | {(INF, float(i)) for i in range(6)}


def test_one_heavy_distance_keeps_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(bands, "HEAVY", 10)
    monkeypatch.setattr(bands, "SLOTS", 1)
    df = spark.range(60).selectExpr("concat('n', id) AS s", "id % 3 AS x")
    vectors = pair_distances(df)
    assert bands.band_cuts(vectors.source()) is None
    discover(vectors).collect()
    assert vectors.is_made()


def test_edit_distances_of_single_pairs():
    rng = random.Random(2)
    words = ["lead" + "".join(rng.choice("ab\0é😀") for _ in range(rng.randint(0, 6))) for _ in range(80)] + [None, None]
    axis = coded.Axis("edit", 20)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(82), np.arange(82)))
    tables = []
    for most in (2048, 0):
        bands.WORD_TABLE, was = most, bands.WORD_TABLE
        try:
            tables.append(bands._Words(pa.array(words), axis).gaps(a, b).tolist())
        finally:
            bands.WORD_TABLE = was
    assert tables[0] == tables[1]


def test_a_frame_that_is_made_later(spark):
    made = []
    df = Later(spark, spark.range(1).schema, lambda: made.append(1) or spark.range(3))
    assert df.columns == ["id"] and not made
    assert df.count() == 3 and df.select("id").collect() and made == [1]
    assert brute.median([r[0] for r in df.collect()]) == 1
