"""Run registered queries against their DuckDB oracle (row count, column
names, order-insensitive value hash) - the same gate the driver applies.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v)) if v != int(v) else str(int(v))
    except Exception:
        pass
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sh, sl = digest(scols, srows)
    dh, dl = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and sh == dh
    info = dict(name=name, ok=ok, spark_rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2),
                oracle_s=round(t2 - t1, 2))
    if not ok:
        info["spark_cols"], info["oracle_cols"] = sorted(scols), sorted(dcols)
        diff_s = sorted(set(sl) - set(dl))[:3]
        diff_d = sorted(set(dl) - set(sl))[:3]
        info["only_spark"], info["only_oracle"] = diff_s, diff_d
    return info


def main():
    import __spark_entry__ as E
    from tripleselect.session import get_spark
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        if name not in os_:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(dict(name=name, ok=None, rows_only=n, spark_s=round(time.time() - t0, 2)), flush=True)
            continue
        try:
            info = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            info = dict(name=name, ok=False, error=repr(e)[:600])
        bad += not info["ok"]
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
