"""Run registered queries against their SQL twins and print differences.

Usage: python tests/oracle_check.py [sf] [name ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from nucleoflow import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canon(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if v is None or (isinstance(v, float) and math.isnan(v)):
                cells.append("~")
            else:
                cells.append(repr(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark, con, folder, name) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    t1 = time.time()
    text = entry.oracle_sql().get(name)
    if text is None:
        sample = rows[0].asDict() if rows else None
        return len(rows) > 0, f"rows={len(rows)} spark={t1 - t0:.1f}s (no SQL twin) {str(sample)[:200]}"
    cur = con.execute(text)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    t2 = time.time()
    note = f"rows={len(rows)}/{len(want)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"{note} columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = canon(df.columns, rows), canon(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        only = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
        return False, f"{note} DIFF {len(sa - sb)} {sorted(names)} {only}"
    return True, note


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(names) - len(bad), "of", len(names), "ok; failing:", bad)
