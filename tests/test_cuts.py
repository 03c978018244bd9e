import random

import brute
import pytest

from nearfd import discover, distance_medians, pair_distances
from nearfd.operators import discover as found, pairs


def test_points_are_cut_before_the_shuffle(spark):
    """Discovery shuffled one row per pair and side; points of a task that another one rules out stay in it."""
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(250)], "a int, b int, c int")
    vectors = pair_distances(df)
    sides = pairs.side_combinations(["a", "b", "c"])
    whole, near = found.rfd_points(vectors, sides), found.near_points(vectors, sides)
    assert near.count() < whole.count() / 10
    assert sorted(map(tuple, found.rfd_intervals(near).collect())) == sorted(map(tuple, found.rfd_intervals(whole).collect()))
    plain = vectors.localCheckpoint()
    assert sorted(map(repr, discover(vectors).collect())) == sorted(map(repr, discover(plain).collect()))


@pytest.mark.parametrize("at_a_time,kept", [(2_000_000, 4_000_000), (30, 20)])
def test_medians_count_values_in_the_tasks(spark, monkeypatch, at_a_time, kept):
    """Every pair was a row per attribute; now a task hands on a row per value."""
    monkeypatch.setattr(pairs, "COUNTED", at_a_time)
    monkeypatch.setattr(pairs, "KEPT_VALUES", kept)
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 99)}", rng.randint(0, 30), rng.randint(0, 900) / 100) for _ in range(120)]
    vectors = pair_distances(spark.createDataFrame(rows, "s string, n int, x double"))
    want = {c: brute.median([r[i] for r in map(tuple, vectors.collect())]) for i, c in enumerate("snx")}
    assert dict(map(tuple, distance_medians(vectors).collect())) == pytest.approx(want)
    plan = distance_medians(vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
