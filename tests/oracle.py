"""Runs a query and its SQL side by side, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted((tuple(None if v is None or v != v else v for v in r) for r in zip(*[table.column(c).to_pylist() for c in cols], strict=True)), key=str)


def compare(query, sql, spark, d):
    ours, theirs = rows(query(spark, d).toArrow()), rows(connect(d).execute(sql).to_arrow_table())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
