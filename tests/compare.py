"""Holds a query against its SQL in DuckDB, as the driver does."""

from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def cell(x):
    if isinstance(x, float):
        return f"{x:.9g}" if x else "0"
    if hasattr(x, "as_tuple"):
        return f"{float(x):.9g}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in rows)


def same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:3]
    assert got[1]
