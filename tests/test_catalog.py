"""Queries against their SQL twins, on the small tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from quillsift.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: No row at this size; checked at larger ones.
MAY_BE_EMPTY = {"retention_latest"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    mine, theirs = rows(catalog.QUERIES[name](spark, DIR).toPandas()), rows(duck.sql(catalog.ORACLES[name]).df())
    assert mine == theirs
    assert mine[1] or name in MAY_BE_EMPTY


def test_entry_module():
    """The driver's three functions, with every query and twin of the catalog."""
    import __spark_entry__ as entry

    assert callable(entry.entry) and set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
