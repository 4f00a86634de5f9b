"""Comparison of a query's rows with those of DuckDB on the same Parquet tables."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return round(x, 9) if isinstance(x, float) else x


def rows_of(records, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in records), key=repr)


def compare(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert rows_of([r.asDict() for r in df.collect()], columns) == rows_of(expected, columns)
