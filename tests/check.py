"""Run registered queries against their SQL twins: python tests/check.py [folder] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return value


def compare(spark, con, folder: str, name: str) -> str | None:
    """None if both sides give the same rows, else what differs."""
    df = queries()[name](spark, folder)
    got_names = sorted(df.columns)
    got = sorted(([normal(r[c]) for c in got_names] for r in df.collect()), key=repr)
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != got_names:
        return f"columns {got_names} vs {sorted(names)}"
    order = [names.index(c) for c in got_names]
    want = sorted(([normal(row[i]) for i in order] for row in rel.fetchall()), key=repr)
    if got == want:
        return None if got else "no rows on either side"
    have, need = set(map(repr, got)), set(map(repr, want))
    return (f"rows {len(got)} vs {len(want)}; only here: {sorted(have - need)[:2]}; "
            f"only in SQL: {sorted(need - have)[:2]}")[:1500]


if __name__ == "__main__":
    from skillgrid.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
