"""Compare registered queries with their SQL on DuckDB.

    python -m tests.oracle_check [names... | @catalog_module...]
"""

from __future__ import annotations

import datetime as dt
import importlib
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in order) for r in raw)
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)} sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first: {g[:3]} {diff[:6]}"
    return None


def main(argv):
    from pulsegrid.session import local_session
    import __spark_entry__ as e

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    names = []
    for a in argv or list(qs):
        names += list(importlib.import_module(f"pulsegrid.catalog.{a[1:]}").QUERIES) if a[0] == "@" else [a]
    failed = []
    for name in names:
        t0 = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, sf_dir, qs[name], sqls[name])
                kind = "sql"
            else:
                rows = qs[name](spark, sf_dir).collect()
                msg, kind = (None if rows else "no rows"), f"rows={len(rows)}"
        except Exception as ex:  # report and go on with the next query
            msg, kind = f"{type(ex).__name__}: {str(ex)[:600]}", "error"
        print(f"{'FAIL' if msg else 'ok  '} {name} [{kind}] {time.time() - t0:.1f}s {msg or ''}", flush=True)
        if msg:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} pass; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    sys.exit(main(sys.argv[1:]))
