"""Run a query on Spark and its SQL on DuckDB, and say where they differ."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """Values as both engines can give them."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return int(v) if float(v).is_integer() else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v.asDict().values() if hasattr(v, "asDict") else v))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, query, sql, sf_dir=SF_DIR):
    """Differences as text, empty if none; and the number of rows."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}", len(got)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got != want:
        a, b = [x for x in got if x not in want][:2] if len(got) < 5000 else got[:1], [x for x in want if x not in got][:2] if len(want) < 5000 else want[:1]
        return f"{cols}: {len(got)} and {len(want)} rows; only Spark {str(a)[:900]}; only SQL {str(b)[:900]}", len(got)
    return "", len(got)
