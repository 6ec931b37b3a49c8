"""Each registered query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pandas as pd
import pytest

from quarry.plans import file_queries, index_queries, ingest_queries, insight_queries, more_queries, registry, rule_queries, search_queries, text_queries, ticket_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    return str(v)[:19] if hasattr(v, "year") else v


def rows(df):
    c = sorted(df.columns)
    return c, sorted((tuple(map(plain, r)) for r in df[c].itertuples(index=False)), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())
