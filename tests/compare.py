"""Runs registered queries on Spark and on DuckDB and compares the rows; also a script: compare.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(spark, con, query, sql, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    b_names, b = rows_of([c[0] for c in res.description], res.fetchall())
    if a_names != b_names:
        return [f"columns {a_names} against {b_names}"]
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}"] + [f"only one side: {x}" for x in list(set(a) ^ set(b))[:4]]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    near = [(x, y) for x, y in bad if not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p)) for p, q in zip(x, y))]
    return [f"{x} against {y}" for x, y in near[:3]]


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, queries, sqls = session(), duck(sys.argv[1]), e.queries(), e.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or queries:
        t = time.time()
        try:
            if name in sqls:
                bad = differences(spark, con, queries[name], sqls[name], sf_dir)
                print(name, "ok" if not bad else f"DIFFERS {bad}", f"{time.time() - t:.1f}s", flush=True)
            else:
                print(name, "rows", queries[name](spark, sf_dir).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(name, "FAILED", str(x)[-1500:], flush=True)
