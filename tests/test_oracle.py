"""Every registered query of the reference surface against DuckDB, on the smallest tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from tidewater import queries

DATA = "/root/testdata/sf0.001"


def values(df):
    cols = sorted(df.columns)
    return sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x).removesuffix(" 00:00:00") for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), cols


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_all_against_duckdb(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    known, oracle = queries.queries(), queries.oracle_sql()
    assert known.keys() == oracle.keys()
    with ThreadPoolExecutor(4) as pool:
        found = dict(zip(known, pool.map(lambda f: f(spark, DATA).toPandas(), known.values()), strict=True))
    wrong = []
    for name, df in found.items():
        if values(df) != values(con.sql(oracle[name]).df()):
            wrong.append(name)
    assert not wrong
