"""Run registered queries beside their SQL and compare rows.

python tests/oracle.py [sf_dir] [name substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rainweave.workloads.registry import TABLES  # noqa: E402


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return took, len(got), "rows only" if got else "NO ROWS"
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return took, len(got), f"COLUMNS {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        return took, len(got), f"ROWS {len(got)} != {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e or any(type(a) is not type(b) for a, b in zip(g, e))]
    if bad:
        return took, len(got), f"VALUES {len(bad)} differ, first {bad[0]}"
    return took, len(got), "ok" if got else "ok BUT EMPTY"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            took, n, verdict = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            took, n, verdict = 0.0, 0, f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += not (verdict.startswith("ok") or verdict == "rows only") or "EMPTY" in verdict
        print(f"{name:42s} {took:6.2f}s {n:8d} {verdict}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
