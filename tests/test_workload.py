"""Every registered query against its SQL twin, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from tidemark import workload
from tools.check_queries import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


workload.load_all()


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, db, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan
    cur = db.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


def test_entry(spark):
    assert E.entry(spark).count() > 0

