"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    text = lambda v: "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(text(r[n]) for n in names) for r in table.to_pylist())


def same(spark, sf_dir, query, sql):
    got = rows(query(spark, sf_dir).toArrow())
    found = connect(sf_dir).sql(sql)
    want = rows(found.to_arrow_table() if hasattr(found, "to_arrow_table") else found.arrow().read_all())
    assert got == want
    return len(got[1])
