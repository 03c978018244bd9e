import random

from nearfd import similarity_join
from nearfd.operators import simjoin

INF, NAN = float("inf"), float("nan")


def test_strings_are_the_keys_if_fewer_rows_meet_on_them(spark, monkeypatch):
    """A wide band beside names made nearly all pairs candidates."""
    rng = random.Random(6)
    rows = [(i, rng.choice([None, f"Name#{rng.randint(0, 400):04}"]), rng.choice([None, NAN, INF, rng.randint(0, 900) / 10])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    on = {"x": ("abs", 30.0), "s": ("edit", 1.0)}
    get = lambda how: sorted(repr(tuple(r)) for r in similarity_join(df, df, on, how).collect())
    want = [get(how) for how in ("inner", "left_semi", "left_anti")]
    made = []
    by_strings = simjoin._fewer_by_strings
    monkeypatch.setattr(simjoin, "FEW", 10)
    monkeypatch.setattr(simjoin, "_fewer_by_strings", lambda *a: made.append(by_strings(*a)) or made[-1])
    assert [get(how) for how in ("inner", "left_semi", "left_anti")] == want
    assert made and all(m is not None for m in made)
