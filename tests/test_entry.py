import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, norm

# one query per family; the whole list: python tests/check_oracles.py sf0.01
NAMES = ["pair_distances_nulls", "skyline_lineitem", "discover_all_part", "rfd_violations", "rfd_extent",
         "string_join", "similarity_anti", "extend_wildcard", "relax_rows", "rank_rfds", "rfd_json_roundtrip",
         "sort_table", "taxonomy_distance", "taxonomy_extension", "stream_topk"]


def test_every_query_has_sql():
    """Queries of the training-data subpackage are tested with it."""
    own = getattr(entry.llm_queries, "QUERIES", {})
    assert set(entry.queries()) - set(own) == set(entry.oracle_sql()) - set(own)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["rfd_id", "rhs", "rhs_threshold", "lhs"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, data)
    order = sorted(df.columns)
    assert order == sorted(cols)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr) == want
