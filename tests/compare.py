"""Run registered queries next to their DuckDB twin: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(plain(r[i]) for i in order) for r in rows
    )


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL twin)"
    t0 = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - t0
    note = f"rows={len(got)} {took:.1f}s sql={sql_took:.1f}s"
    if got_cols != want_cols:
        return False, f"{note} columns {got_cols} vs {want_cols}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return False, f"{note} want rows={len(want)}\n   spark {only_got}\n   duck  {only_want}"
    return True, note


def main() -> int:
    import __spark_entry__ as e
    from tests.session import session

    args = sys.argv[1:]
    sf = args[0] if args else "0.001"
    names = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
