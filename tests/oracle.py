"""Spark rows against DuckDB's, whatever their order."""

import glob
import math
import os

import duckdb
import numpy as np


def _value(x):
    if x is None or (isinstance(x, (float, np.floating)) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return "null"
    if isinstance(x, (list, np.ndarray)):
        return str([_value(y) for y in x])
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return f"{float(x):.6f}"
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_value, r)) for r in frame.itertuples(index=False))


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def check(spark, sf_dir, query, sql):
    want = rows(duck(sf_dir).execute(sql).df())
    got = rows(query(spark, sf_dir).toPandas())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(*(x[1] for x in (got, want))):
        assert a == b
