"""Compares a query with its SQL in DuckDB over one data folder."""

from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def same(spark, con, query, sql):
    df = query(spark, str(FOLDER))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    return got == table([c[0] for c in cur.description], cur.fetchall())
