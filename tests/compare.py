"""Run registered queries next to their SQL twins and compare row multisets by column name.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    # A twin that does not fit is ended, and its spill is not left in the working folder.
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='run-')}'")
    con.execute("SET max_temp_directory_size = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, q, sf_dir):
    """Return (ok, message). Values must be equal, not merely close."""
    df = q.build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"row counts {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {sorted(names)}: {bad[0]}"
    return len(got) > 0, f"rows {len(got)}"


def main():
    from typetrace.plans import REGISTRY
    from typetrace.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.typetrace.spread": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failed = []
    for n in names:
        t = time.time()
        try:
            ok, msg = compare(spark, con, REGISTRY[n], sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(names) - len(failed)} ok, failed: {failed}")


if __name__ == "__main__":
    main()
