"""Spark-vs-DuckDB check of the registered queries (what the driver's correctness gate does).

    python -m lendflow.plans.check /root/testdata/sf0.01 [name ...]

Compares column names, row counts and an order-insensitive multiset of canonical row values.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import json
import math
import os
import sys
import time

import numpy as np

from lendflow.sources.tables import TABLES, table_path

# CHECK_STRICT=1 compares doubles exactly instead of rounded to 9 places.
STRICT = os.environ.get("CHECK_STRICT", "0") == "1"


def canon(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (decimal.Decimal, np.floating, float)):
        f = float(v)
        return None if math.isnan(f) else (f if STRICT else round(f, 9))
    if isinstance(v, (np.integer, int)) and not isinstance(v, bool):
        return int(v)
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat()
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(canon(r[i]) for i in order) for r in records]
    rows.sort(key=repr)
    return [columns[i] for i in order], rows


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def compare(spark, sf_dir: str, name: str, qfn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t1 = time.time()
    out = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connection(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out["oracle_rows"] = len(drows)
    sc, sr = rows_of(scols, [tuple(r) for r in srows])
    dc, dr = rows_of(dcols, drows)
    out["columns_match"] = sc == dc
    out["rows_match"] = len(sr) == len(dr)
    out["values_match"] = sr == dr
    if not out["columns_match"]:
        out["spark_columns"], out["oracle_columns"] = sc, dc
    elif not out["values_match"]:
        bad = {}
        for i, c in enumerate(sc):
            a = sorted((repr(r[i]) for r in sr))
            b = sorted((repr(r[i]) for r in dr))
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                bad[c] = diff
        out["mismatch"] = bad
    out["status"] = "ok" if (out["columns_match"] and out["values_match"]) else "FAIL"
    return out


def main(argv):
    from lendflow.plans.oracle import oracle_sql
    from lendflow.plans.queries import queries
    from lendflow.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, sqls = queries(), oracle_sql()
    con = duck_connection(sf_dir)
    failed = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as e:  # report and keep going
            r = {"query": name, "status": "ERROR", "error": repr(e)[:600]}
        failed += r["status"] in ("FAIL", "ERROR")
        print(json.dumps(r, default=str), flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
