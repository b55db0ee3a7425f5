"""Lag, throughput, roll-ups and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import millis_to_ntz, ntz_millis, truncate_time
from tidemark.functions.text import table_badge
from tidemark.operators import latency as L, metrics as M
from tidemark.plans import monitoring
from tidemark.session import shared_dir
from tidemark.sinks import stores
from tidemark.workload import query
from tidemark.workload.inputs import SAMPLES, samples, table

HOUR = "HOUR"
SCN_WIDTH = 1_000_000


def _last(df, column="sampled_at", grain=None):
    top = F.max(column)
    return df.agg(truncate_time(grain, top) if grain else top).scalar()


# --- roll-ups ----------------------------------------------------------------------


def _rollup_sql(grain: str, fine: str, source: str) -> str:
    return f"""
      SELECT date_trunc('{grain}', sampled_at) AS sampled_at, metric, metric_name,
             CASE WHEN metric IN ('PUBLISH','APPLY_JDBC','APPLY_ICEBERG') THEN CAST(sum(sample_value) AS BIGINT)
                  WHEN metric IN ('LAG_JDBC','LAG_ICEBERG') THEN max(sample_value)
                  ELSE CAST(round(avg(sample_value)) AS BIGINT) END AS sample_value,
             CASE WHEN metric = 'RESOURCE' THEN CAST(round(avg(sample_value2)) AS BIGINT) END AS sample_value2,
             '{grain.upper()}' AS resolution
      FROM {source}
      WHERE resolution = '{fine}' AND sampled_at < (SELECT date_trunc('{grain}', max(ts)) FROM events)
      GROUP BY 1, 2, 3"""


HOURS = f"WITH s AS ({SAMPLES}) " + _rollup_sql("hour", "MIN", "s")
ALL_HOURS = f"WITH s AS ({SAMPLES}), h AS ({_rollup_sql('hour', 'MIN', 's')})"


def _hours(spark, sf_dir):
    s = samples(spark, sf_dir)
    return M.rollup(s, "HOUR", _last(s, grain="HOUR"))


@query(HOURS)
def rollup_hour(spark, sf_dir):
    return _hours(spark, sf_dir)


@query(ALL_HOURS + _rollup_sql("day", "HOUR", "h"))
def rollup_day(spark, sf_dir):
    return M.rollup(_hours(spark, sf_dir), "DAY", _last(samples(spark, sf_dir), grain="DAY"))


@query(
    ALL_HOURS + """ SELECT * FROM h
       WHERE (sampled_at, metric, metric_name) NOT IN
             (SELECT sampled_at, metric, metric_name FROM h WHERE metric <> 'RESOURCE')"""
)
def rollup_again(spark, sf_dir):
    """Hours already rolled, here all but resources, are not rolled again."""
    s, hours = samples(spark, sf_dir), _hours(spark, sf_dir)
    present = s.unionByName(hours.where("metric <> 'RESOURCE'"))
    return M.rollup(present, "HOUR", _last(s, grain="HOUR"))


_KEPT = """
  WITH s AS ({samples}), h AS ({hours}), a AS (SELECT * FROM s UNION ALL SELECT * FROM h),
       n AS (SELECT max(ts) AS now FROM events)
  SELECT a.* FROM a, n WHERE (resolution = 'MIN' AND sampled_at >= now - INTERVAL 48 HOUR)
     OR (resolution = 'HOUR' AND sampled_at >= now - INTERVAL 60 DAY)
""".format(samples=SAMPLES, hours=_rollup_sql("hour", "MIN", "s"))


@query(_KEPT)
def purge_samples(spark, sf_dir):
    s = samples(spark, sf_dir)
    return M.purge_samples(s.unionByName(_hours(spark, sf_dir)), _last(s))


_STORE = """
  WITH s AS ({samples}), h AS ({hours}), d AS ({days}), n AS (SELECT max(ts) AS now FROM events),
       a AS (SELECT * FROM s UNION ALL SELECT * FROM h UNION ALL SELECT * FROM d)
  SELECT resolution, metric, count(*) AS n, CAST(sum(sample_value) AS BIGINT) AS total
  FROM a, n WHERE resolution <> 'MIN' OR sampled_at >= now - INTERVAL 48 HOUR
  GROUP BY 1, 2
""".format(
    samples=SAMPLES,
    hours=_rollup_sql("hour", "MIN", "s"),
    days=_rollup_sql("day", "HOUR", "h"),
)


@query(_STORE)
def sample_store(spark, sf_dir):
    """Samples stored, rolled up twice and purged in the store."""
    path = shared_dir(spark, "samples")
    s = samples(spark, sf_dir)
    stores.append_samples(s, path)
    now = s.agg(F.max("sampled_at")).first()[0]
    stores.roll_store(spark, path, now)
    stores.roll_store(spark, path, now)
    return (
        stores.read_samples(spark, path)
        .groupBy("resolution", "metric")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("sample_value").alias("total"))
    )


# --- charts -------------------------------------------------------------------------


@query(
    ALL_HOURS + """ SELECT sampled_at AS ts, metric, CAST(sum(sample_value) AS BIGINT) AS agg FROM h
      WHERE metric IN ('PUBLISH', 'LAG_JDBC') GROUP BY 1, 2"""
)
def series(spark, sf_dir):
    since = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return M.series(_hours(spark, sf_dir), "HOUR", since, ["PUBLISH", "LAG_JDBC"])


def _wide_sql(first: str, a: str, second: str, b: str) -> str:
    return (
        ALL_HOURS
        + f""" SELECT sampled_at AS ts,
          CAST(sum(CASE WHEN metric = '{a}' THEN sample_value ELSE 0 END) AS BIGINT) AS {first},
          CAST(sum(CASE WHEN metric = '{b}' THEN sample_value ELSE 0 END) AS BIGINT) AS {second}
          FROM h WHERE metric IN ('{a}', '{b}') GROUP BY 1"""
    )


def _always():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


@query(_wide_sql("publish", "PUBLISH", "apply", "APPLY_JDBC"))
def dashboard_throughput(spark, sf_dir):
    return M.dashboard_throughput(_hours(spark, sf_dir), "HOUR", _always())


@query(_wide_sql("jdbc", "LAG_JDBC", "iceberg", "LAG_ICEBERG"))
def dashboard_lag(spark, sf_dir):
    return M.dashboard_lag(_hours(spark, sf_dir), "HOUR", _always(), "all")


@query(
    f"""WITH s AS ({SAMPLES}), r AS (
      SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY sampled_at DESC) AS rn
      FROM s WHERE metric = 'RESOURCE')
    SELECT metric_name AS component, coalesce(sample_value2, 0) / 10.0 AS cpu_pct,
           sample_value // 1024 AS rss_mb FROM r WHERE rn = 1"""
)
def resources_now(spark, sf_dir):
    return M.resources_now(samples(spark, sf_dir), _always())


# --- counters: the running event count of a user ------------------------------------

_COUNTER = """SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS reading,
              epoch_us(ts) // 1000 AS at_ms FROM events"""


def _readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.floor("value").cast("bigint").alias("reading"),
        ntz_millis("ts").alias("at_ms"),
    )


@query(
    f"""WITH c AS ({_COUNTER}), p AS (
      SELECT *, lag(reading) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM c)
    SELECT event_id, user_id, reading - prev AS delta FROM p WHERE prev IS NOT NULL AND reading >= prev"""
)
def counter_delta(spark, sf_dir):
    found = M.counter_delta(
        _readings(spark, sf_dir), ["user_id"], ["event_id"], "reading", F.col("event_id"), SCN_WIDTH
    )
    return found.select("event_id", "user_id", "delta")


@query(
    f"""WITH c AS ({_COUNTER}), p AS (
      SELECT *, lag(reading) OVER w AS prev, lag(at_ms) OVER w AS prev_at FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id))
    SELECT event_id, CASE WHEN at_ms > prev_at AND reading >= prev
      THEN CAST(round((reading - prev) * 1000.0 / (at_ms - prev_at) * 1000000) AS BIGINT) ELSE 0 END AS rate_x1m
    FROM p"""
)
def event_rate(spark, sf_dir):
    found = M.event_rate(_readings(spark, sf_dir), ["user_id"], "at_ms", "reading", ["event_id"])
    return found.select(
        "event_id", F.round(F.col("events_per_sec") * 1_000_000).cast("bigint").alias("rate_x1m")
    )


@query(
    f"""WITH c AS ({_COUNTER}), r AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM c)
    SELECT user_id, string_agg(CAST(reading AS VARCHAR), ',' ORDER BY event_id) AS points
    FROM r WHERE rn <= 24 GROUP BY user_id"""
)
def recent_points(spark, sf_dir):
    found = M.recent_points(_readings(spark, sf_dir), "user_id", "event_id", "reading")
    return found.select(
        "user_id", F.array_join(F.col("points").cast("array<string>"), ",").alias("points")
    )


@query(
    f"""WITH c AS ({_COUNTER})
    SELECT event_id, array_to_string(list(reading) OVER (
      PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), ',') AS points
    FROM c"""
)
def point_history(spark, sf_dir):
    found = M.point_history(
        _readings(spark, sf_dir), ["user_id"], ["event_id"], "reading", F.col("event_id"), SCN_WIDTH
    )
    return found.select(
        "event_id", F.array_join(F.col("points").cast("array<string>"), ",").alias("points")
    )


# --- offsets ---------------------------------------------------------------------------
# Each event is one observation of its user's topic: end offset event_id, lags by value.

_OBS = """SELECT ts AS sampled_at, 'u' || CAST(user_id AS VARCHAR) AS topic, event_id AS total_events,
          CAST(floor(value) AS BIGINT) - 20 AS jdbc_lag, user_id % 5 AS iceberg_lag FROM events"""


def _observations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("sampled_at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("topic"),
        F.col("event_id").alias("total_events"),
        (F.floor("value").cast("bigint") - 20).alias("jdbc_lag"),
        (F.col("user_id") % 5).alias("iceberg_lag"),
    )


_THROUGHPUT = f"""
  o AS ({_OBS}), c AS (
    SELECT sampled_at, topic, 'PUBLISH' AS metric, total_events AS v FROM o
    UNION ALL SELECT sampled_at, topic, 'APPLY_JDBC', total_events - greatest(0, jdbc_lag) FROM o
    UNION ALL SELECT sampled_at, topic, 'APPLY_ICEBERG', total_events - greatest(0, iceberg_lag) FROM o),
  p AS (SELECT *, lag(v) OVER (PARTITION BY metric, topic ORDER BY sampled_at) AS prev FROM c),
  t AS (SELECT sampled_at, metric, topic AS metric_name, v - prev AS sample_value FROM p
        WHERE prev IS NOT NULL AND v >= prev
        UNION ALL SELECT sampled_at, 'LAG_JDBC', topic, greatest(0, jdbc_lag) FROM o
        UNION ALL SELECT sampled_at, 'LAG_ICEBERG', topic, greatest(0, iceberg_lag) FROM o)
"""


@query(f"WITH {_THROUGHPUT} SELECT * FROM t")
def throughput_samples(spark, sf_dir):
    found = M.throughput_samples(_observations(spark, sf_dir))
    return found.select("sampled_at", "metric", "metric_name", "sample_value")


@query(
    f"""WITH {_THROUGHPUT}
    SELECT o.sampled_at, o.topic, o.jdbc_lag <= 0 AND t.sample_value = 0 AS quiet
    FROM o JOIN t ON t.metric = 'PUBLISH' AND t.metric_name = o.topic AND t.sampled_at = o.sampled_at"""
)
def quiet_topics(spark, sf_dir):
    observations = _observations(spark, sf_dir)
    found = M.quiet_topics(observations, M.throughput_samples(observations))
    return found.select("sampled_at", "topic", "quiet")


_TOPICS = """
  topics AS (SELECT DISTINCT 'u' || CAST(o_custkey AS VARCHAR) AS topic FROM orders),
  ends AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS topic, max(event_id) AS end_offset FROM events GROUP BY 1),
  jdbc AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS topic, max(event_id) AS committed FROM events
           WHERE event_type = 'view' AND user_id % 7 > 0 GROUP BY 1),
  ice AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS topic, max(event_id) AS committed FROM events
          WHERE event_type = 'click' GROUP BY 1),
  lags AS (SELECT topics.topic, coalesce(end_offset, 0) AS total_events,
             CASE WHEN jdbc.committed IS NULL THEN coalesce(end_offset, 0)
                  ELSE greatest(0, coalesce(end_offset, 0) - jdbc.committed) END AS jdbc_lag,
             CASE WHEN ice.committed IS NULL THEN coalesce(end_offset, 0)
                  ELSE greatest(0, coalesce(end_offset, 0) - ice.committed) END AS iceberg_lag
           FROM topics LEFT JOIN ends ON ends.topic = topics.topic
           LEFT JOIN jdbc ON jdbc.topic = topics.topic LEFT JOIN ice ON ice.topic = topics.topic)
"""


def _lags(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(
        "topic", F.concat(F.lit("u"), F.col("user_id").cast("string"))
    )
    topics = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("topic")
    ).distinct()
    ends = e.groupBy("topic").agg(F.max("event_id").alias("end_offset"))

    def commits(sink, rows):
        return rows.groupBy("topic").agg(F.max("event_id").alias("committed")).withColumn(
            "sink", F.lit(sink)
        )

    both = commits("JDBC", e.where("event_type = 'view' AND user_id % 7 > 0")).unionByName(
        commits("ICEBERG", e.where("event_type = 'click'"))
    )
    return M.table_lags(topics, ends, both)


@query(f"WITH {_TOPICS} SELECT * FROM lags")
def table_lags(spark, sf_dir):
    return _lags(spark, sf_dir)


@query(
    f"WITH {_TOPICS} SELECT CAST(sum(greatest(jdbc_lag, 0)) AS BIGINT) AS remaining,"
    " sum(greatest(jdbc_lag, 0)) = 0 AS drained FROM lags"
)
def drain_gate(spark, sf_dir):
    return M.drained(_lags(spark, sf_dir))


@query(
    f"""WITH {_TOPICS}, s AS (SELECT topic, jdbc_lag, CASE total_events % 4 WHEN 0 THEN 'RUNNING'
          WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'N/A' ELSE 'FAILED' END AS state FROM lags)
    SELECT topic, CASE WHEN state = 'RUNNING' AND jdbc_lag > 100 THEN 'warn' WHEN state = 'RUNNING' THEN 'ok'
      WHEN state IN ('PAUSED', 'N/A') THEN 'dim' ELSE 'crit' END AS badge FROM s"""
)
def table_badges(spark, sf_dir):
    step = F.col("total_events") % 4
    state = F.when(step == 0, "RUNNING").when(step == 1, "PAUSED").when(step == 2, "N/A")
    rows = _lags(spark, sf_dir).withColumn("state", state.otherwise("FAILED"))
    return rows.select("topic", table_badge("state", "jdbc_lag").alias("badge"))


# --- process samples ---------------------------------------------------------------------

_PROC = """SELECT event_id, ts AS sampled_at, epoch_us(ts) // 1000 AS at_ms,
  'c' || CAST(user_id % 10 AS VARCHAR) AS component, user_id AS pid,
  CASE WHEN event_type = 'error' THEN -1 ELSE CAST(round(value * 100) AS BIGINT) END AS rss_kb,
  CASE WHEN event_type = 'view' THEN -1 ELSE event_id * 3 + user_id END AS ticks FROM events"""


def _proc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rss = F.round(F.col("value") * 100).cast("bigint").cast("string")
    status = F.when(
        F.col("event_type") != "error", F.concat(F.lit("Name:\tx\nVmRSS:\t   "), rss, F.lit(" kB\nX: 1"))
    ).otherwise("Name:\tx\nVmSize: 5 kB")
    head = F.concat(F.col("pid").cast("string"), F.lit(" ((a b) c) S 1 2 3 4 5 6 7 8 9 10 "))
    stat = F.when(
        F.col("event_type") != "view",
        F.concat(head, (F.col("event_id") * 3).cast("string"), F.lit(" "),
                 F.col("pid").cast("string"), F.lit(" 0 0 20")),
    ).otherwise("12 (x) S 1 2")
    rows = e.withColumns({"pid": F.col("user_id"), "sampled_at_ms": ntz_millis("ts")})
    return rows.select(
        "event_id",
        F.col("ts").alias("sampled_at"),
        "sampled_at_ms",
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("component"),
        "pid",
        status.alias("status_text"),
        stat.alias("stat_text"),
    )


@query(f"SELECT event_id, rss_kb, ticks AS cpu_ticks FROM ({_PROC})")
def parse_proc(spark, sf_dir):
    return M.parse_proc(_proc(spark, sf_dir)).select("event_id", "rss_kb", "cpu_ticks")


@query(
    f"""WITH p AS ({_PROC}), l AS (
      SELECT *, lag(ticks) OVER w AS pt, lag(at_ms) OVER w AS pa FROM p
      WINDOW w AS (PARTITION BY component, pid ORDER BY at_ms))
    SELECT event_id, rss_kb AS sample_value, CASE WHEN ticks >= pt AND at_ms > pa
      THEN CAST(floor(((ticks - pt) / 100.0) / ((at_ms - pa) / 1000.0) * 100 * 10 + 0.5) AS BIGINT) ELSE 0 END AS cpu
    FROM l WHERE rss_kb >= 0"""
)
def cpu_percent(spark, sf_dir):
    cpu = M.cpu_percent(M.parse_proc(_proc(spark, sf_dir)))
    return cpu.where("rss_kb >= 0").select(
        "event_id", F.col("rss_kb").alias("sample_value"), F.col("cpu_pct_x10").alias("cpu")
    )


_STORED = f"""
  WITH {_THROUGHPUT}, s AS (SELECT *, CAST(NULL AS BIGINT) AS sample_value2, 'MIN' AS resolution FROM t),
  h AS ({_rollup_sql("hour", "MIN", "s")})
"""


@query(
    _STORED
    + """ SELECT sampled_at AS ts, CAST(sum(CASE WHEN metric = 'PUBLISH' THEN sample_value ELSE 0 END) AS BIGINT) AS publish,
      CAST(sum(CASE WHEN metric = 'APPLY_JDBC' THEN sample_value ELSE 0 END) AS BIGINT) AS apply
      FROM h WHERE metric IN ('PUBLISH', 'APPLY_JDBC') GROUP BY 1"""
)
def monitoring_chain(spark, sf_dir):
    """Observations to samples, stored, rolled up, purged, and read back as a chart."""
    store = shared_dir(spark, "monitoring")
    observations = _observations(spark, sf_dir)
    now = observations.agg(F.max("sampled_at")).first()[0]
    monitoring.ingest(spark, observations, store, now)
    charts = monitoring.dashboard(spark, store, "HOUR", 24 * 60, now)
    return charts["throughput"]


_LATE = "epoch_us(ts) // 1000 + CAST(abs(round(value * 100)) AS BIGINT) % 5000 + CASE WHEN user_id % 10 = 0 THEN 60000 ELSE 0 END"


@query(
    f"""WITH e AS (SELECT epoch_us(ts) // 1000 AS s, {_LATE} AS t FROM events)
    SELECT date_trunc('day', make_timestamp(t * 1000)) AS at, CAST(count(*) AS BIGINT) AS n, max(t - s) AS max_ms,
           true AS p50_near, true AS p95_near, true AS p99_near FROM e GROUP BY 1"""
)
def capture_latency(spark, sf_dir):
    """Latencies sketched per minute, stored, merged to hours and days; quantiles against exact ranks."""
    e = table(spark, sf_dir, "events")
    own = ntz_millis("ts")
    late = F.abs(F.round(F.col("value") * 100)).cast("bigint") % 5000 + F.when(F.col("user_id") % 10 == 0, 60000).otherwise(0)
    events = e.select(F.struct(own.alias("ts_ms")).alias("source"), (own + late).alias("ts_ms"))
    path = shared_dir(spark, "latency")
    L.latency_sketches(events).write.parquet(path)
    days = L.latency_quantiles(L.merge_latency(L.merge_latency(spark.read.parquet(path), "HOUR"), "DAY"))
    day = truncate_time("DAY", millis_to_ntz(F.col("ts_ms")))
    exact = events.select(day.alias("at"), L.latency_ms().alias("ms")).join(days, "at")
    near = []
    for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = F.count_if(F.col("ms") < F.col(name)), F.count_if(F.col("ms") <= F.col(name))
        near.append(((below / F.first("n") <= share + 0.02) & (upto / F.first("n") >= share - 0.02)).alias(f"{name}_near"))
    return exact.groupBy("at").agg(F.first("n").alias("n"), F.first("max_ms").alias("max_ms"), *near)
