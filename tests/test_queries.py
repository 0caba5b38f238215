"""Every registered query outside the optional subpackage against its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([plain(x) for x in v])
    if v is None or pd.isna(v):
        return "~"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    return str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
