"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_integer_ratio"):
        return round(float(value), 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    took = f"{t1 - t0:.1f}s / {time.time() - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        only_got = [r for r in got[:20000] if r not in set(want)][:2]
        only_want = [r for r in want[:20000] if r not in set(got)][:2]
        return False, f"{len(got)} rows != {len(want)} rows; spark {only_got}; sql {only_want}; cols {sorted(names)} ({took})"
    return True, f"{len(got)} rows ({took})"


def main() -> None:
    from lintlake.session import build_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    qs, sqls = queries(), oracle_sql()
    for name, query in qs.items():
        if names and not any(n in name for n in names):
            continue
        try:
            if name in sqls:
                ok, note = compare(spark, con, name, sf_dir, query, sqls[name])
            else:
                t0 = time.time()
                ok, note = True, f"{query(spark, sf_dir).count()} rows, no SQL ({time.time() - t0:.1f}s)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, str(e)[:1500]
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
