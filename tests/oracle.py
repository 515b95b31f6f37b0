"""A query's rows in Spark and in DuckDB, as the same plain Python values."""

import os

import duckdb


def connected(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        table, path = name.split(".")[0], f"{sf_dir}/{name}"
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def ordered(columns, rows):
    """Rows with their columns by name, floats to nine places, in the order of their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def same(spark, db, query, sql, sf_dir):
    got, want = query(spark, sf_dir), db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = got.collect()
    assert ordered(got.columns, rows) == ordered(names, want.fetchall())
    return len(rows)
