"""Run every query next to its SQL: python tests/check_oracles.py <sf> [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.10g}")
    return str(v)


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    path = f"/root/testdata/{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    sql = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            t = time.time()
            df = query(spark, path)
            rows = df.collect()
            spent = time.time() - t
            if name not in sql:
                print(f"{name:28} rows {len(rows):8} {spent:6.2f}s (no SQL)", flush=True)
                continue
            t = time.time()
            cur = con.execute(sql[name])
            cols = [c[0] for c in cur.description]
            want = cur.fetchall()
            sql_spent = time.time() - t
            order = sorted(df.columns)
            got_set = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
            if sorted(cols) != order:
                raise AssertionError(f"columns {order} != {sorted(cols)}")
            at = [cols.index(c) for c in order]
            want_set = sorted((tuple(norm(r[i]) for i in at) for r in want), key=repr)
            ok = got_set == want_set
            print(f"{name:28} rows {len(rows):8} {spent:6.2f}s sql {sql_spent:6.2f}s {'ok' if ok else 'DIFFERENT'}", flush=True)
            if not ok:
                bad.append(name)
                a, b = set(got_set), set(want_set)
                print("   only spark", len(a - b), sorted(a - b, key=repr)[:3], "\n   only sql", len(b - a),
                      sorted(b - a, key=repr)[:3], len(want))
        except Exception as e:  # report and go on with the other queries
            bad.append(name)
            print(f"{name:28} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
