"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [name-prefix ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return "rows", len(got), ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "COLS", len(got), f"{cols} vs {sorted(names)}"
    ix = [names.index(c) for c in cols]
    exp = sorted((tuple(norm(r[i]) for i in ix) for r in cur.fetchall()), key=repr)
    if got == exp and repr(got) == repr(exp):
        return "ok", len(got), ""
    if len(got) != len(exp):
        return "ROWCOUNT", len(got), f"{len(got)} vs {len(exp)} got {got[:2]} exp {exp[:2]} cols {cols}"
    bad = [(g, e) for g, e in zip(got, exp) if repr(g) != repr(e)]
    return "VALUES", len(got), f"{len(bad)} differ, cols {cols} got {bad[0][0]} exp {bad[0][1]}"


def main(prefixes, sf="/root/testdata/sf0.01"):
    from rekurve.plans.session import local_session
    import __spark_entry__ as entry

    spark, con = local_session(), connect(sf)
    qs, os_ = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            status, n, note = compare(spark, con, name, fn, os_.get(name), sf)
        except Exception as e:  # report and go on
            status, n, note = "ERROR", 0, str(e)[:600]
        if status not in ("ok", "rows"):
            fails += 1
        print(f"{status:8s} {name:40s} {n:7d} {time.time() - t:6.2f}s {note[:700]}", flush=True)
    print("failures", fails)
    return fails


if __name__ == "__main__":
    main(sys.argv[1:])
