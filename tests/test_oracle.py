"""Each query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from cloakframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
