"""Rows of a query beside those of its DuckDB counterpart."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(map(norm, v.values())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def oracle_rows(sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted("|".join(norm(row[i]) for i in order) for row in r.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted("|".join(norm(r[c]) for c in names) for r in df.collect())
