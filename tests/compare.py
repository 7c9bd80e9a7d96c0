"""Local stand-in for the driver's correctness gate: run a registered
query on Spark and its oracle SQL on DuckDB over the same parquet files,
then compare row count, column names and types, and order-insensitive
values."""

from __future__ import annotations

import math
import os
import sys

import duckdb

# COMPARE_EXACT=1: floats must be bit-equal (default: rounded to 9 places)
EXACT = os.environ.get("COMPARE_EXACT") == "1"

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v if EXACT else round(v, 9)
    if hasattr(v, "as_tuple"):  # Decimal
        return float(v) if EXACT else round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


_TYPES = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE",
          "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "FloatType": "FLOAT",
          "ShortType": "SMALLINT", "ByteType": "TINYINT", "DateType": "DATE",
          "TimestampType": "TIMESTAMP"}


def spark_types(sdf) -> dict:
    out = {}
    for f in sdf.schema.fields:
        t = type(f.dataType).__name__
        if t == "DecimalType":
            out[f.name] = f"DECIMAL({f.dataType.precision},{f.dataType.scale})"
        else:
            out[f.name] = _TYPES.get(t, t)
    return out


def type_mismatches(sdf, res) -> list:
    st = spark_types(sdf)
    dt = {d[0]: str(d[1]).upper() for d in res.description}
    return [(c, st.get(c), dt.get(c)) for c in st if c in dt and st[c] != dt[c]]


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None, verbose=True):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    bad_types = type_mismatches(sdf, res)
    if verbose and bad_types:
        print(f"[{name}] type differences (spark, duck): {bad_types}")
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
    ok_v = ok_cols and a == b
    if verbose and not (ok_cols and ok_n and ok_v):
        print(f"[{name}] cols spark={s_cols} duck={d_cols} rows {len(s_rows)} vs {len(d_rows)}")
        diff_a = [x for x in a if x not in set(b)][:5]
        diff_b = [x for x in b if x not in set(a)][:5]
        print("  spark-only:", diff_a)
        print("  duck-only: ", diff_b)
    return ok_cols, ok_n, ok_v


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import time

    import __spark_entry__ as E
    from tractus.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        if name not in sqls:
            n = fn(spark, sf).count()
            print(f"{name:34s} rows-only n={n} {time.time()-t:.1f}s")
            continue
        try:
            r = compare(spark, name, fn, sqls[name], sf, con)
        except Exception as e:  # noqa: BLE001
            r = (False, False, False)
            print(f"[{name}] ERROR {type(e).__name__}: {str(e)[:400]}")
        bad += not all(r)
        print(f"{name:34s} cols={r[0]} rows={r[1]} values={r[2]} {time.time()-t:.1f}s")
    print("FAILED" if bad else "ALL OK", bad)
