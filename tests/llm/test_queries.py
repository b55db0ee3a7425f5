"""The registered queries that SQL can express, against their twins."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES
from tools.check_queries import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rows = [tuple(x) for x in df.collect()]
    found = db.execute(ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(rows, df.columns) == normal(found.fetchall(), names)
