"""Compares a query's rows with its SQL run by DuckDB, as multisets."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if hasattr(x, "isoformat") else x


def differences(con, sql: str, df) -> tuple[int, list]:
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols, (sorted(want.columns), cols)
    want = Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())
    return sum(got.values()), [*(("only Spark", *x) for x in list((got - want).elements())[:3]), *(("only SQL", *x) for x in list((want - got).elements())[:3])]
