from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import rows
from tidemark.model import METRIC_SAMPLE
from tidemark.operators import metrics as M
from tidemark.plans import monitoring
from tidemark.sinks import stores
from tidemark.sources.tables import jdbc_options, read_offsets

H0 = datetime(2026, 7, 28, 10)


def at(minutes=0, hours=0, days=0):
    return H0 + timedelta(minutes=minutes, hours=hours, days=days)


def ntz(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def frame(spark, data):
    full = [(t, m, n, v, *(rest or (None,)), "MIN") if len(rest) < 2 else (t, m, n, v, *rest) for t, m, n, v, *rest in data]
    return spark.createDataFrame(full, METRIC_SAMPLE)


def test_series_sums_tables(spark):
    df = frame(spark, [(H0, "PUBLISH", "T1", 100), (H0, "PUBLISH", "T2", 40), (at(-5), "PUBLISH", "T1", 1)])
    assert [r["agg"] for r in M.series(df, "MIN", ntz(H0), ["PUBLISH"]).collect()] == [140]
    assert [r["agg"] for r in M.series(df, "MIN", ntz(H0), ["PUBLISH"], "T1").collect()] == [100]


def test_rollup_kinds(spark):
    df = frame(
        spark,
        [
            (at(1), "PUBLISH", "T1", 10), (at(2), "PUBLISH", "T1", 30),
            (at(1), "LAG_JDBC", "T1", 5), (at(2), "LAG_JDBC", "T1", 999), (at(3), "LAG_JDBC", "T1", 0),
            (at(1), "RESOURCE", "c", 1, 3), (at(2), "RESOURCE", "c", 2, None), (at(3), "RESOURCE", "d", 1),
            (at(1), "OTHER", "T1", 5), (at(61), "PUBLISH", "T1", 7),
        ],
    )
    hours = M.rollup(df, "HOUR", ntz(at(hours=1)))
    assert rows(hours.select("sampled_at", "metric", "metric_name", "sample_value", "sample_value2").fillna(-1)) == [
        (H0, "LAG_JDBC", "T1", 999, -1), (H0, "PUBLISH", "T1", 40, -1), (H0, "RESOURCE", "c", 2, 3), (H0, "RESOURCE", "d", 1, -1),
    ]
    both = df.unionByName(hours)
    assert M.rollup(both, "HOUR", ntz(at(hours=1))).count() == 0
    # A sample that comes late for a rolled hour is never added.
    late = both.unionByName(frame(spark, [(at(30), "PUBLISH", "T1", 1000)]))
    assert M.rollup(late, "HOUR", ntz(at(hours=1))).count() == 0
    # The open hour closes one hour later.
    assert rows(M.rollup(late, "HOUR", ntz(at(hours=2))).select("sample_value")) == [(7,)]


def test_day_average_is_over_hours(spark):
    df = frame(spark, [(at(hours=h), "RESOURCE", "c", v, v, "HOUR") for h, v in enumerate([1, 2, 4, 3])])
    got = M.rollup(df, "DAY", ntz(at(days=1).replace(hour=0))).first()
    assert (got["sampled_at"], got["sample_value"], got["resolution"]) == (H0.replace(hour=0), 3, "DAY")


def test_purge_is_strict_by_age(spark):
    data = []
    for res, hours in M.KEEP_HOURS.items():
        data += [(at(hours=-hours), "PUBLISH", f"{res}-keep", 1, None, res), (at(hours=-hours, minutes=-1), "PUBLISH", f"{res}-drop", 1, None, res)]
    got = rows(M.purge_samples(frame(spark, data), ntz(H0)).select("metric_name"))
    assert got == [("DAY-keep",), ("HOUR-keep",), ("MIN-keep",)]


def test_sample_store_rolls_once_and_purges(spark, path):
    data = [(at(minutes=-m), "PUBLISH", "T1", 1) for m in range(0, 72 * 60, 10)]
    stores.append_samples(frame(spark, data), path)
    now = at(minutes=5)
    for _ in range(2):
        stores.roll_store(spark, path, now)
    got = {r[0]: (r[1], r[2]) for r in stores.read_samples(spark, path).groupBy("resolution").agg(F.count("*"), F.sum("sample_value")).collect()}
    kept = [d for d in data if d[0] >= now - timedelta(hours=48)]
    closed = [d for d in data if d[0] < H0]
    days = [d for d in closed if d[0] < H0.replace(hour=0)]
    assert got["MIN"] == (len(kept), len(kept))
    assert got["HOUR"] == (len({d[0].replace(minute=0) for d in closed}), len(closed))
    assert got["DAY"] == (len({d[0].date() for d in days}), len(days))


def test_dashboard(spark):
    df = frame(spark, [(H0, "PUBLISH", "T1", 5), (H0, "PUBLISH", "T2", 6), (at(1), "APPLY_JDBC", "T1", 7), (at(2), "APPLY_ICEBERG", "T1", 9), (at(2), "LAG_ICEBERG", "T1", 3)])
    assert rows(M.dashboard_throughput(df, "MIN", ntz(H0))) == [(H0, 11, 0), (at(1), 0, 7)]
    assert rows(M.dashboard_throughput(df, "MIN", ntz(H0), "T2")) == [(H0, 6, 0)]
    assert rows(M.dashboard_lag(df, "MIN", ntz(H0), "all")) == [(at(2), 0, 3)]
    assert [M.clamp_hours("MIN", h) for h in (0, 5, 99)] == [1, 5, 48]
    with pytest.raises(ValueError):
        M.clamp_hours("WEEK", 1)


def test_resources_now(spark):
    df = frame(spark, [(at(-20), "RESOURCE", "gone", 9000, 1), (at(-5), "RESOURCE", "a", 4096, 15), (at(-1), "RESOURCE", "a", 2047, 25), (at(-2), "RESOURCE", "b", 10240, None)])
    assert [tuple(r) for r in M.resources_now(df, ntz(at(-10))).collect()] == [("b", 0.0, 10), ("a", 2.5, 1)]


def test_lag_defaults(spark):
    topics = spark.createDataFrame([("a",), ("b",), ("c",), ("new",)], "topic string")
    ends = spark.createDataFrame([("a", 100), ("b", 50), ("c", 10)], "topic string, end_offset bigint")
    commits = spark.createDataFrame([("a", "JDBC", 90), ("a", "ICEBERG", 100), ("c", "JDBC", 20)], "topic string, sink string, committed bigint")
    lags = M.table_lags(topics, ends, commits)
    assert rows(lags) == [("a", 100, 10, 0), ("b", 50, 50, 50), ("c", 10, 0, 10), ("new", 0, 0, 0)]
    assert tuple(M.drained(lags).first()) == (60, False)
    assert tuple(M.drained(lags.where("topic in ('c', 'new')")).first()) == (0, True)
    assert tuple(M.drained(lags.where("false")).first()) == (0, True)


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_counter_skips_first_and_reset(spark, hot_rows):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10, 15, 15, 3, 8])], "k string, i bigint, v bigint")
    got = M.counter_delta(df, ["k"], ["i"], "v", F.col("i"), 2, hot_rows)
    assert rows(got.select("i", "delta")) == [(1, 5), (2, 0), (4, 5)]


def test_rate(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in [(1000, 10), (2000, 20), (4000, 21), (5000, 3)]], "k string, t bigint, v bigint")
    got = M.event_rate(df, ["k"], "t", "v").orderBy("t")
    assert [r["events_per_sec"] for r in got.collect()] == [0.0, 10.0, 0.5, 0.0]


def test_throughput_and_quiet(spark):
    obs = [(at(0), "a", 100, 10, 0), (at(1), "a", 150, 20, -5), (at(2), "a", 150, 0, 0), (at(3), "a", 40, 0, 0)]
    df = spark.createDataFrame(obs, "sampled_at timestamp_ntz, topic string, total_events bigint, jdbc_lag bigint, iceberg_lag bigint")
    s = M.throughput_samples(df)
    got = {}
    for r in s.orderBy("sampled_at").collect():
        got.setdefault(r["metric"], []).append(r["sample_value"])
    assert got == {"PUBLISH": [50, 0], "APPLY_JDBC": [40, 20], "APPLY_ICEBERG": [50, 0], "LAG_JDBC": [10, 20, 0, 0], "LAG_ICEBERG": [0, 0, 0, 0]}
    assert rows(M.quiet_topics(df, s).select("sampled_at", "quiet")) == [(at(1), False), (at(2), True)]


def test_recent_points(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "k string, i bigint")
    got = {r["k"]: r["points"] for r in M.recent_points(df, "k", "i", "i").collect()}
    assert got == {"a": list(range(6, 30)), "b": [1]}


def test_cpu(spark):
    rows_in = [("c", 1, 0, 1000, 100), ("c", 1, 60_000, 4000, 100), ("c", 1, 120_000, 3000, 100), ("c", 2, 120_000, 50, -1), ("c", 1, 121_000, 3100, 5)]
    df = spark.createDataFrame(rows_in, "component string, pid bigint, sampled_at_ms bigint, cpu_ticks bigint, rss_kb bigint")
    cpu = M.cpu_percent(df)
    assert rows(cpu.select("pid", "sampled_at_ms", "cpu_pct_x10")) == [(1, 0, 0), (1, 60_000, 500), (1, 120_000, 0), (1, 121_000, 1000), (2, 120_000, 0)]
    assert M.resource_samples(cpu.withColumn("sampled_at", ntz(H0))).count() == 4


def test_monitoring_chain(spark, path):
    topics = spark.createDataFrame([("a",)], "topic string")
    obs = None
    for m in range(0, 130, 10):
        ends = spark.createDataFrame([("a", m * 5)], "topic string, end_offset bigint")
        commits = spark.createDataFrame([("a", "JDBC", m * 4)], "topic string, sink string, committed bigint")
        one = monitoring.observe(topics, ends, commits, at(m))
        obs = one if obs is None else obs.unionByName(one)
    now = at(125)
    monitoring.ingest(spark, obs, path, now)
    charts = monitoring.dashboard(spark, path, "HOUR", 10, now)
    assert rows(charts["throughput"]) == [(H0, 250, 200), (at(hours=1), 300, 240)]
    assert rows(charts["lag"]) == [(H0, 50, 250), (at(hours=1), 110, 550)]


def test_offsets_from_progress(spark):
    df = spark.createDataFrame([('{"t1": {"0": 5, "1": 7}, "t2": {"0": 1}}',)], "offsets string")
    assert rows(read_offsets(df)) == [("t1", 12), ("t2", 1)]


def test_jdbc_reads_in_ranges():
    o = jdbc_options("jdbc:x", "T", "ID", (0, 100), 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("ID", "0", "100", "8")
    assert "partitionColumn" not in jdbc_options("jdbc:x", "T", None, None, 8)
