"""Run registered queries next to their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows))


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_by_name([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return "" if got[1] else "no rows on either side"
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    missing = [r for r in want[1] if r not in set(got[1])][:2]
    return f"{len(got[1])} rows vs {len(want[1])}; only spark {extra}; only sql {missing}"[:3000]


if __name__ == "__main__":
    from askorpus.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(), connect(sf)
    for n in names:
        t = time.time()
        try:
            if n in entry.oracle_sql():
                problem = compare(spark, con, n, sf) or "ok"
            else:
                problem = f"rows only: {entry.queries()[n](spark, sf).count()}"
        except Exception as e:
            problem = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{n:28s} {time.time() - t:6.1f}s {problem}", flush=True)
