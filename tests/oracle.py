"""Runs registered queries and their SQL side by side and compares names and values.

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def compare(df, con, sql) -> str | None:
    """None when both give the same rows, else a description of the difference."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} of {len(mine)} rows differ, columns {sorted(names)}, first {bad[0]}"
    return None


def main(argv: list[str]) -> int:
    from packetloom.catalog import ORACLES, QUERIES
    from packetloom.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf), 0
    for name in wanted:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                problem, note = None, f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            problem = note = f"ERROR {type(e).__name__} {str(e)[:400]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - t:6.1f}s {note}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
