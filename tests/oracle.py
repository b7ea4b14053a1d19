"""Runs a query and its SQL side by side."""

import os

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=str)


def connected(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t[:-8]} as select * from '{sf}/{t}'")
    return con


def same(con, df, sql):
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())
