"""The sliced forms give the rows of the plain windows, with hot keys forced."""

import random

import pytest
from pyspark.sql import Window, functions as F

from fixtures import rows
from tidemark.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        # Gaps and bursts along the order column.
        at = rng.choice([rng.randrange(0, 50), rng.randrange(5000, 5060), rng.randrange(10**6)])
        out.append((i, key, at, rng.choice([None, rng.randrange(100)])))
    df = spark.createDataFrame(out, "i int, k string, at bigint, v int")
    return df.repartition(5)


@pytest.mark.parametrize("hot_rows,width", [(10, 7), (10, 1), (10, 10**7), (200, 40), (10**9, 7)])
def test_previous(data, hot_rows, width):
    got = ordered.previous(
        data, ["k"], ["at", "i"], {"pv": "v", "pat": "at"}, F.col("at"), width, hot_rows, present="has"
    )
    w = Window.partitionBy("k").orderBy("at", "i")
    want = data.withColumns(
        {"pv": F.lag("v").over(w), "pat": F.lag("at").over(w), "has": F.lag("at").over(w).isNotNull()}
    )
    key = lambda df: sorted(map(str, df.select("i", "k", "at", "v", "pv", "pat", "has").collect()))
    assert key(got) == key(want)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("hot_rows,width", [(10, 7), (10, 10**7), (10**9, 7)])
def test_running_sum(data, keys, hot_rows, width):
    got = ordered.running_sum(data, keys, ["at", "i"], F.col("i"), "s", F.col("at"), width, hot_rows)
    w = Window.partitionBy(*keys).orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = data.withColumn("s", F.sum("i").over(w))
    assert rows(got.select("i", "s")) == rows(want.select("i", "s"))


@pytest.mark.parametrize("n", [1, 2, 5, 24])
@pytest.mark.parametrize("hot_rows,width", [(10, 1), (10, 60), (10**9, 7)])
def test_recent_values(data, n, hot_rows, width):
    got = ordered.recent_values(data, ["k"], ["at", "i"], "i", n, "r", F.col("at"), width, hot_rows)
    w = Window.partitionBy("k").orderBy("at", "i").rowsBetween(-(n - 1), 0)
    want = data.withColumn("r", F.collect_list("i").over(w))
    assert rows(got.select("i", "r")) == rows(want.select("i", "r"))


def test_latest_limits_on_the_map_side(data):
    df = ordered.latest(data, ["k"], [F.col("at").desc(), F.col("i").desc()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.count() == 5


def test_cold_keys_leave_the_plain_window(data):
    """Without a hot key adaptive execution drops the carry branch."""
    df = ordered.previous(data, ["k"], ["at", "i"], {"pv": "v"}, F.col("at"), 7)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final
