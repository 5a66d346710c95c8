"""Runs registered queries against their SQL in DuckDB: python -m tests.compare FOLDER [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, f, sql):
    t = time.time()
    df = f(spark, folder)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s", True
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    have = rows_of(df.columns, got)
    ok = sorted(columns) == sorted(df.columns) and want == have
    text = f"{name}: {len(got)} rows, SQL {len(want)}, {'same' if ok else 'DIFFERENT'}, {took:.1f} s"
    if not ok:
        a, b = set(map(repr, have)), set(map(repr, want))
        text += f"\n  columns {df.columns} {columns}\n  only here {sorted(a - b)[:3]}\n  only SQL {sorted(b - a)[:3]}"
    return text, ok


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for n in sorted(os.listdir(folder)):
        if n.endswith(".parquet"):
            path = f"{folder}/{n}"
            con.execute(f"create view {n[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def main(folder, *names):
    import __spark_entry__ as entry

    spark, con = session(), connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if not names or name in names or any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            try:
                text, ok = compare(spark, con, folder, name, f, sql.get(name))
            except Exception as e:  # noqa: BLE001
                text, ok = f"{name}: {type(e).__name__} {str(e)[:1500]}", False
            bad += not ok
            print(text, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
