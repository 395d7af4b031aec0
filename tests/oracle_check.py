"""Run registered queries beside their SQL: python tests/oracle_check.py SF_DIR [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    """A value both engines agree on: whole numbers as int, floats by their text."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(plain(row[i]) for i in order) for row in rows))


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """None if equal, else what differs; and both engines' seconds."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return (None if got[1] else "no rows"), t1 - t0, 0.0, len(got[1])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"{len(got[1])} rows != {len(want[1])}"
    elif got[1] != want[1]:
        bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        problem = f"{len(bad)} rows differ, first {bad[0]}"
    return problem, t1 - t0, t2 - t1, len(got[1])


def main(argv):
    import __spark_entry__ as entry
    from tidewatch.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problem, ours, theirs, n = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem, ours, theirs, n = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        mark = "ok" if problem is None else "FAIL"
        kind = "" if name in sqls else " (rows only)"
        print(f"{mark:4} {name:28} {n:7} rows  spark {ours:6.2f}s  sql {theirs:6.2f}s{kind}"
              + (f"\n     {problem[:900]}" if problem else ""), flush=True)
        failed += [name] if problem else []
    print("failed:", failed or "none")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
