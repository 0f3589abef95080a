"""Run a query beside its SQL twin and compare columns and values, whatever the order of the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
        return plain(x) if not isinstance(x, list) else tuple(plain(y) for y in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("+00:00", "").removesuffix("T00:00:00")
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (order, a, b)
    return len(mine)
