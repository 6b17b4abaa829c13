"""Runs a query and its SQL side by side and compares the rows as bags."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got_names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in got_names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == got_names
    want = sorted((tuple(plain(r[names.index(c)]) for c in got_names) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
