"""Compare a query's rows with those of its SQL in DuckDB."""

import decimal
import glob
import math
import os

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return str(v)


def connection(folder: str = SMALL):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(spark, query, sql: str, con, folder: str = SMALL) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert got == want
