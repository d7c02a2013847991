"""Compare a registered query with its SQL twin on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def sql_rows(sql, sf_dir, columns):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    return sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)
