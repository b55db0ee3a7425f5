import pytest
from pyspark.sql import functions as F

from fixtures import FOUR, event, events, rows
from tidemark.operators.lookup import lookup
from tidemark.operators.routing import exclude_paused, include_tables


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_broadcast_and_salted_forms_agree(spark, how):
    big = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("9", 4)], "name string, v int")
    a = lookup(big, small, {"name": F.col("k")}, ["id"], how)
    b = lookup(big, small, {"name": F.col("k")}, ["id"], how, salts=3)
    assert a.columns == b.columns and rows(a.fillna("-").fillna(0)) == rows(b.fillna("-").fillna(0))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tables_in_and_out(spark):
    df = events(spark, [*FOUR, event("c", 5, after=(1, "", ""), table="T2"), event("c", 6, after=(1, "", ""), table="T3")])
    some = spark.createDataFrame([("CDC", "T2"), ("CDC", "T2"), ("X", "T3")], "schema_name string, table_name string")
    assert rows(include_tables(df, some).select("source.scn")) == [("5",)]
    assert rows(exclude_paused(df, some).select("source.scn")) == [("1000",), ("1010",), ("1020",), ("1030",), ("6",)]
