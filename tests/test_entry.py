import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from casekit.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "verdict" in df.columns


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(df):
    cols = sorted(df.columns)
    data = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted((tuple(_norm(x) for x in r) for r in data.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
