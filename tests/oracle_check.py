"""Run every registered query at one scale and compare with its DuckDB twin.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: same row count, same column names, same values
(order-insensitive; doubles compared after rounding to 6 decimals).
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(rows, cols):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in idx) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def spark_kind(dt) -> str:
    n = type(dt).__name__
    return {"LongType": "int", "IntegerType": "int", "ShortType": "int", "ByteType": "int",
            "DoubleType": "float", "FloatType": "float", "DecimalType": "decimal",
            "StringType": "str", "BooleanType": "bool", "TimestampType": "ts",
            "TimestampNTZType": "ts", "DateType": "date"}.get(n, n)


def duck_kind(t) -> str:
    t = str(t).upper()
    if t in ("BIGINT", "INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER"):
        return "int"
    if t in ("DOUBLE", "FLOAT"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t in ("VARCHAR", "STRING"):
        return "str"
    if t == "BOOLEAN":
        return "bool"
    if t.startswith("TIMESTAMP"):
        return "ts"
    return t


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, df=None):
    t = time.time()
    df = fn(spark, sf_dir) if df is None else df
    rows = [tuple(r) for r in df.collect()]
    cols = df.columns
    ts = time.time() - t
    if sql is None:
        return "rows-only", f"{len(rows)} rows", ts
    res = con.execute(sql)
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    if sorted(cols) != sorted(ocols):
        return "FAIL", f"columns {sorted(cols)} vs {sorted(ocols)}", ts
    sk = {f.name: spark_kind(f.dataType) for f in df.schema.fields}
    dk = {c[0]: duck_kind(c[1]) for c in res.description}
    kinds = [f"{c}:{sk[c]}/{dk[c]}" for c in cols if sk[c] != dk[c]]
    if kinds:
        return "FAIL", f"types differ {kinds}", ts
    if len(rows) != len(orows):
        return "FAIL", f"rows {len(rows)} vs {len(orows)}", ts
    a, b = canon(rows, cols), canon(orows, ocols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return "FAIL", f"values differ, e.g. {diff} (cols {sorted(cols)})", ts
    return "ok", f"{len(rows)} rows", ts


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as entry
    from roughcut.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            status, msg, ts = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            status, msg, ts = "ERROR", f"{type(e).__name__}: {str(e)[:300]}", 0.0
        bad += status in ("FAIL", "ERROR")
        print(f"{status:9s} {name:28s} {ts:6.2f}s  {msg}", flush=True)
    print(f"{len(qs)} queries, {len(sqls)} with oracle, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
