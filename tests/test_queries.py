"""Every query with an oracle agrees with DuckDB on the small tables."""

import duckdb
import pytest

from pixelmill.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, db, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    want = db.execute(Q.oracle_sql()[name]).fetch_df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x
    key = lambda f: sorted(repr([plain(x.item() if hasattr(x, "item") else x) for x in r]) for r in f[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_queries_without_oracle_have_rows(spark):
    for name in set(Q.queries()) - set(Q.oracle_sql()):
        assert Q.queries()[name](spark, DATA).count() > 0


def test_plan_is_native_and_pruned(spark):
    plan = Q.queries()["region_to_oriented"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "l_extendedprice" not in plan
