"""Run a query and its SQL on the same tables and compare all rows, columns sorted by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4; SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, float):
            return f"{x:.9g}" if x else "0"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(one, x)) + "]"
        return str(x)

    return tuple(map(one, row))


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = sorted(_key(r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    rel = connect(sf_dir).sql(sql)
    want = sorted(_key(r) for r in rel.select(*[f'"{c}"' for c in sorted(rel.columns)]).fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (sorted(df.columns), sorted(rel.columns))
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
