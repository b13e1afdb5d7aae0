"""Compare queries with their SQL on DuckDB: python tests/oracle_check.py DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(d: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(d).iterdir()):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{src}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, d, name, query, sql) -> str:
    df = query(spark, d)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    q = con.execute(sql)
    types = {x[0]: str(x[1]) for x in q.description}
    b = rows_of(list(types), q.fetchall())
    if a == b:
        return ""
    diff = next((f"{x} != {y}" for x, y in zip(a[1], b[1], strict=False) if x != y), "")
    return f"columns {a[0]} {b[0]}, rows {len(a[1])} {len(b[1])}, first difference {diff}"[:600]


if __name__ == "__main__":
    import __spark_entry__ as e
    from weftline.session import local_session

    os.environ.setdefault("TZ", "UTC")
    spark = local_session(8)
    con = connect(sys.argv[1])
    sql, qs = e.oracle_sql(), e.queries()
    for name in sys.argv[2:] or list(qs):
        t = time.time()
        try:
            if name in sql:
                bad = compare(spark, con, sys.argv[1], name, qs[name], sql[name])
                print("ok  " if not bad else "BAD ", name, f"{time.time() - t:.1f}", bad, flush=True)
            else:
                print("rows", name, f"{time.time() - t:.1f}", qs[name](spark, sys.argv[1]).count(), flush=True)
        except Exception as ex:  # noqa: BLE001
            print("FAIL", name, str(ex)[:700], flush=True)
