"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from turnwise import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [shown(y) for y in x]
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and math.isnan(x):
        return "null"
    return f"{x + 0:.9g}" if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(str([shown(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry_point_registers_all():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
