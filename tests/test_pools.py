import brute
import numpy as np
import pandas as pd

from nearfd import skyline
from nearfd.plans import blocks


def test_pools_with_guards(monkeypatch):
    monkeypatch.setattr(blocks, "GUARD_ROWS", 20)
    monkeypatch.setattr(blocks, "WAITING", 50)
    rng = np.random.default_rng(3)
    rows = np.where(rng.random((4000, 3)) < 0.01, np.inf, rng.integers(0, 40, (4000, 3)).astype(float))
    pool, out = blocks.Pool(["a", "b", "c"], 50_000), []
    for lo in range(0, 4000, 130):
        out += pool.add(pd.DataFrame(rows[lo:lo + 130], columns=["a", "b", "c"]))
    assert pool.guards and pool.size < 1000
    out += pool.rest()
    assert {tuple(r) for p in out for r in p.to_numpy()} == brute.minimal(set(map(tuple, rows)))


def test_skyline_folds_after_the_cut(spark, monkeypatch):
    seen = []
    cut = blocks.local_minima
    import nearfd.operators.skyline as s
    monkeypatch.setattr(s, "local_minima", lambda p, *a: seen.append(p) or cut(p, *a))
    df = spark.range(2000).selectExpr("id % 50 as x", "id % 7 as y")
    assert {tuple(r) for r in skyline(df, ["x", "y"]).collect()} == {(0, 0)}
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
