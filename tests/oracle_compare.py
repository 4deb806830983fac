"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Columns are sorted by name, rows by value; doubles compared to 1e-9 relative.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from cauldron.sources.tables import TABLE_NAMES  # noqa: E402


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) if isinstance(v, str) else (1, v) for v in row)


EXACT = bool(int(__import__("os").environ.get("ORACLE_EXACT", "0")))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        if EXACT:
            return a == b
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems, len(s_rows), len(d_rows)
    si = [s_cols.index(c) for c in sorted(s_cols)]
    di = [d_cols.index(c) for c in sorted(d_cols)]
    s_n = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    d_n = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if len(s_n) != len(d_n):
        problems.append(f"row count spark={len(s_n)} duck={len(d_n)}")
    bad = 0
    for a, b in zip(s_n, d_n):
        if not all(_same(x, y) for x, y in zip(a, b)):
            bad += 1
            if bad <= 3:
                problems.append(f"row differs:\n  spark={a}\n  duck ={b}")
    if bad:
        problems.append(f"{bad} differing rows; columns={sorted(s_cols)}")
    return problems, len(s_rows), len(d_rows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from cauldron.session import build_session

    spark = build_session()
    con = duck_connection(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name not in oracle:
                n = df.count()
                print(f"[rows-only] {name}: {n} rows ({time.time() - t0:.1f}s)")
                continue
            problems, ns, nd = compare(df, con, oracle[name])
        except Exception as exc:  # report and go on
            failed += 1
            print(f"[ERR] {name}: {str(exc).splitlines()[0][:300]}")
            continue
        status = "OK " if not problems else "BAD"
        failed += bool(problems)
        print(f"[{status}] {name}: spark={ns} duck={nd} ({time.time() - t0:.1f}s)")
        for p in problems:
            print("      " + p)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
