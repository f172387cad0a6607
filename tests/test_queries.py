"""Every query with SQL gives the same rows as that SQL in DuckDB, and every query runs."""

import duckdb
import pytest
from strandline.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    flat = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in flat.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, DATA).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert [tuple(map(str, r)) for r in got[1]] == [tuple(map(str, r)) for r in want[1]]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
