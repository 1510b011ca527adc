"""Run a registered query on Spark and its SQL twin on DuckDB and compare all values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, int):
        return str(v)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql, con=None, allow_empty=False):
    """None if equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    cols_s, rows_s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols_d, rows_d = rows_of(names, cur.fetchall())
    if cols_s != cols_d:
        return f"columns {cols_s} vs {cols_d}"
    if len(rows_s) != len(rows_d):
        diff = f"rows {len(rows_s)} vs {len(rows_d)}"
    elif rows_s != rows_d:
        diff = "values"
    else:
        return None if rows_s or allow_empty else "both empty"
    only_s = sorted(set(rows_s) - set(rows_d))[:2]
    only_d = sorted(set(rows_d) - set(rows_s))[:2]
    return f"{diff}\n  columns {cols_s}\n  spark only {only_s}\n  duckdb only {only_d}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_spark

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = make_spark()
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                problem = compare(spark, sf_dir, query, oracles[name], con)
            else:
                n = query(spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - t0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s" + (f" {problem}" if problem else ""), flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
