"""Lag, throughput, resource samples and their roll-ups.

Samples are one tall relation: sampled_at, metric, metric_name, sample_value,
sample_value2, resolution (MIN, HOUR, DAY).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import mean_half_away, ntz_millis, truncate_time
from tidemark.functions.text import cpu_ticks, rss_kb
from tidemark.operators.ordered import HOT_ROWS, latest, previous, recent_values

# How each metric rolls up, and how long each resolution is kept.
SUM_METRICS = ("PUBLISH", "APPLY_JDBC", "APPLY_ICEBERG")
MAX_METRICS = ("LAG_JDBC", "LAG_ICEBERG")
AVG_METRICS = ("RESOURCE",)
KEEP_HOURS = {"MIN": 48, "HOUR": 24 * 60, "DAY": 24 * 365}
TICKS_PER_SECOND = 100

FINER = {"HOUR": "MIN", "DAY": "HOUR"}
#: Slice width for hot keys in time order.
MINUTE_MS = 60_000
SAMPLE_COLUMNS = [
    "sampled_at", "metric", "metric_name", "sample_value", "sample_value2", "resolution",
]


# --- lag ---------------------------------------------------------------------


def lag_of(end: Column, committed: Column) -> Column:
    """Everything when nothing is committed, else what is left, never below zero."""
    return F.when(committed.isNull(), end).otherwise(F.greatest(F.lit(0), end - committed))


def table_lags(topics: DataFrame, ends: DataFrame, commits: DataFrame) -> DataFrame:
    """Per topic: end offset (0 for an unknown topic) and the lag of both sinks.

    ``commits`` holds (topic, sink, committed) with sink JDBC or ICEBERG.
    """
    per_topic = commits.groupBy("topic").agg(
        F.max(F.when(F.col("sink") == "JDBC", F.col("committed"))).alias("_jdbc"),
        F.max(F.when(F.col("sink") == "ICEBERG", F.col("committed"))).alias("_ice"),
    )
    end = F.coalesce("end_offset", F.lit(0))
    return (
        topics.select("topic").join(ends.select("topic", "end_offset"), "topic", "left")
        .join(per_topic, "topic", "left")
        .select(
            "topic",
            end.alias("total_events"),
            lag_of(end, F.col("_jdbc")).alias("jdbc_lag"),
            lag_of(end, F.col("_ice")).alias("iceberg_lag"),
        )
    )


def drained(lags: DataFrame, lag: str = "jdbc_lag") -> DataFrame:
    """One row: what remains over all tables; at zero the stream is drained."""
    total = F.coalesce(F.sum(F.greatest(F.col(lag), F.lit(0))), F.lit(0))
    return lags.agg(total.alias("remaining")).withColumn("drained", F.col("remaining") == 0)


# --- counters ----------------------------------------------------------------


def counter_delta(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Growth of a counter since the row before. First rows and falls give no row."""
    df = previous(df, keys, order, {"_prev": value}, position, width, hot_rows)
    grown = F.col("_prev").isNotNull() & (F.col(value) >= F.col("_prev"))
    return df.where(grown).withColumn("delta", F.col(value) - F.col("_prev")).drop("_prev")


def event_rate(
    df: DataFrame,
    keys: Sequence[str],
    at_ms: str,
    value: str,
    order: Sequence[str] = (),
    width: int = MINUTE_MS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``events_per_sec`` against the row before; 0 without a usable one."""
    df = previous(
        df, keys, [at_ms, *order], {"_prev": value, "_at": at_ms}, F.col(at_ms), width, hot_rows
    )
    usable = (F.col(at_ms) > F.col("_at")) & (F.col(value) >= F.col("_prev"))
    rate = (F.col(value) - F.col("_prev")) * F.lit(1000.0) / (F.col(at_ms) - F.col("_at"))
    return df.withColumn("events_per_sec", F.when(usable, rate).otherwise(0.0)).drop("_prev", "_at")


def recent_points(df: DataFrame, key: str, order: str, value: str, n: int = 24) -> DataFrame:
    """The last ``n`` values of each key as text, oldest first.

    The rank filter cuts every key to ``n`` rows on the map side already.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = df.select(key, order, value).withColumn("_r", F.row_number().over(w))
    points = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.where(F.col("_r") <= n).groupBy(key).agg(
        F.transform(points, lambda e: e["v"]).alias("points")
    )


def point_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    position: Column,
    width: int,
    n: int = 24,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each row with the ``n`` values a chart would have shown at that time."""
    return recent_values(df, keys, order, value, n, "points", position, width, hot_rows)


def throughput_samples(
    observations: DataFrame, width: int = MINUTE_MS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """MIN samples from offset observations (sampled_at, topic, total_events, jdbc_lag, iceberg_lag).

    Published and applied counts become growth since the observation before;
    lags are taken as they are. One pass per topic serves all five metrics.
    """
    left = lambda c: F.col("total_events") - F.greatest(F.lit(0), F.col(c))
    rows = observations.withColumns(
        {
            "_p": F.col("total_events"),
            "_j": left("jdbc_lag"),
            "_i": left("iceberg_lag"),
            "_at": ntz_millis("sampled_at"),
        }
    )
    rows = previous(
        rows, ["topic"], ["_at"], {"_pp": "_p", "_pj": "_j", "_pi": "_i"},
        F.col("_at"), width, hot_rows,
    )
    grown = lambda now, was: F.when(F.col(now) >= F.col(was), F.col(now) - F.col(was))
    metrics = {
        "PUBLISH": grown("_p", "_pp"),
        "APPLY_JDBC": grown("_j", "_pj"),
        "APPLY_ICEBERG": grown("_i", "_pi"),
        "LAG_JDBC": F.greatest(F.lit(0), F.col("jdbc_lag")),
        "LAG_ICEBERG": F.greatest(F.lit(0), F.col("iceberg_lag")),
    }
    pairs = F.array(
        *[F.struct(F.lit(m).alias("m"), v.cast("bigint").alias("v")) for m, v in metrics.items()]
    )
    return (
        rows.select("sampled_at", "topic", F.explode(pairs).alias("_s"))
        .where(F.col("_s.v").isNotNull())
        .select(
            "sampled_at",
            F.col("_s.m").alias("metric"),
            F.col("topic").alias("metric_name"),
            F.col("_s.v").alias("sample_value"),
            F.lit(None).cast("bigint").alias("sample_value2"),
            F.lit("MIN").alias("resolution"),
        )
    )


def quiet_topics(observations: DataFrame, samples: DataFrame) -> DataFrame:
    """Observations with lag 0 and nothing published: no news, not proof of being caught up."""
    published = samples.where(F.col("metric") == "PUBLISH").select(
        "sampled_at", F.col("metric_name").alias("topic"), F.col("sample_value").alias("published")
    )
    flag = (F.col("jdbc_lag") <= 0) & (F.col("published") == 0)
    return observations.join(published, ["sampled_at", "topic"]).withColumn("quiet", flag)


# --- process resources -------------------------------------------------------


def parse_proc(samples: DataFrame) -> DataFrame:
    """Resident memory and CPU ticks of captured process texts."""
    return samples.withColumns(
        {"rss_kb": rss_kb("status_text"), "cpu_ticks": cpu_ticks("stat_text")}
    ).drop("status_text", "stat_text")


def cpu_percent(
    parsed: DataFrame, at_ms: str = "sampled_at_ms", width: int = MINUTE_MS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``cpu_pct_x10``: tenths of a percent since the row before of the same process."""
    df = previous(
        parsed, ["component", "pid"], [at_ms], {"_ticks": "cpu_ticks", "_at": at_ms},
        F.col(at_ms), width, hot_rows,
    )
    usable = (F.col("cpu_ticks") >= F.col("_ticks")) & (F.col(at_ms) > F.col("_at"))
    seconds = (F.col("cpu_ticks") - F.col("_ticks")) / F.lit(float(TICKS_PER_SECOND))
    share = seconds / ((F.col(at_ms) - F.col("_at")) / F.lit(1000.0)) * 100 * 10
    tenths = F.floor(share + 0.5).cast("bigint")
    return df.withColumn(
        "cpu_pct_x10", F.when(usable, tenths).otherwise(F.lit(0).cast("bigint"))
    ).drop("_ticks", "_at")


def resource_samples(cpu: DataFrame) -> DataFrame:
    """MIN samples of processes whose memory could be read."""
    return cpu.where(F.col("rss_kb") >= 0).select(
        "sampled_at",
        F.lit("RESOURCE").alias("metric"),
        F.col("component").alias("metric_name"),
        F.col("rss_kb").alias("sample_value"),
        F.col("cpu_pct_x10").alias("sample_value2"),
        F.lit("MIN").alias("resolution"),
    )


def resources_now(samples: DataFrame, since: Column) -> DataFrame:
    """Latest resource sample per component from ``since`` on, biggest memory first."""
    fresh = samples.where(
        (F.col("resolution") == "MIN")
        & (F.col("metric") == "RESOURCE")
        & (F.col("sampled_at") >= since)
    )
    last = latest(fresh, ["metric_name"], [F.col("sampled_at").desc()])
    return last.select(
        F.col("metric_name").alias("component"),
        (F.coalesce("sample_value2", F.lit(0)) / F.lit(10.0)).alias("cpu_pct"),
        F.call_function("div", F.col("sample_value"), F.lit(1024)).alias("rss_mb"),
    ).orderBy(F.col("rss_mb").desc(), "component")


# --- roll-up -----------------------------------------------------------------


def bucket_sums() -> list[Column]:
    """What a bucket of samples needs of them; all of it adds up in parts."""
    return [
        F.sum("sample_value").alias("_sum"),
        F.max("sample_value").alias("_max"),
        F.count("sample_value").alias("_n"),
        F.sum("sample_value2").alias("_sum2"),
        F.count("sample_value2").alias("_n2"),
    ]


def bucket_values() -> tuple[Column, Column]:
    """Both values of a bucket: counts add up, lags keep their peak, resources average."""
    metric = F.col("metric")
    value = (
        F.when(metric.isin(*SUM_METRICS), F.col("_sum"))
        .when(metric.isin(*MAX_METRICS), F.col("_max"))
        .when(F.col("_n") > 0, mean_half_away(F.col("_sum"), F.col("_n")))
    )
    averaged = metric.isin(*AVG_METRICS)
    return value, F.when(averaged & (F.col("_n2") > 0), mean_half_away(F.col("_sum2"), F.col("_n2")))


def rollup(samples: DataFrame, grain: str, cutoff: Column) -> DataFrame:
    """New HOUR or DAY samples from closed buckets of the next finer resolution.

    Counts add up, lags keep their peak, resources average. A bucket that was
    rolled before is left alone, also when samples for it came in late.
    """
    metric = F.col("metric")
    bucket = truncate_time(grain, "sampled_at")
    fine = samples.where(
        (F.col("resolution") == FINER[grain])
        & (F.col("sampled_at") < cutoff)
        & metric.isin(*SUM_METRICS, *MAX_METRICS, *AVG_METRICS)
    )
    name = ["sampled_at", "metric", "metric_name"]
    grouped = fine.groupBy(bucket.alias("sampled_at"), "metric", "metric_name").agg(*bucket_sums())
    value, value2 = bucket_values()
    done = samples.where(F.col("resolution") == grain).select(*name)
    return grouped.join(done, name, "left_anti").select(
        *name,
        value.alias("sample_value"),
        value2.alias("sample_value2"),
        F.lit(grain).alias("resolution"),
    )


def purge_samples(samples: DataFrame, now: Column) -> DataFrame:
    """Samples young enough for their resolution."""
    keep = F.lit(False)
    for resolution, hours in KEEP_HOURS.items():
        oldest = now - F.expr(f"interval {hours} hours")
        keep = keep | ((F.col("resolution") == resolution) & (F.col("sampled_at") >= oldest))
    return samples.where(keep | ~F.col("resolution").isin(*KEEP_HOURS))


# --- reading -----------------------------------------------------------------


def clamp_hours(resolution: str, hours: int) -> int:
    """A chart window no longer than the resolution is kept."""
    if resolution not in KEEP_HOURS:
        raise ValueError(f"resolution must be MIN, HOUR or DAY: {resolution}")
    return min(max(hours, 1), KEEP_HOURS[resolution])


def series(
    samples: DataFrame, resolution: str, since: Column, metrics: Sequence[str], topic: str | None = None
) -> DataFrame:
    """Sum over tables per time and metric, in time order."""
    rows = samples.where(
        (F.col("resolution") == resolution)
        & (F.col("sampled_at") >= since)
        & F.col("metric").isin(*metrics)
    )
    if topic is not None:
        rows = rows.where(F.col("metric_name") == topic)
    return (
        rows.groupBy(F.col("sampled_at").alias("ts"), "metric")
        .agg(F.sum("sample_value").alias("agg"))
        .orderBy("ts")
    )


def _wide(samples: DataFrame, resolution: str, since: Column, names: dict, topic: str | None):
    rows = samples.where(
        (F.col("resolution") == resolution)
        & (F.col("sampled_at") >= since)
        & F.col("metric").isin(*names.values())
    )
    if topic is not None and topic.strip() and topic.lower() != "all":
        rows = rows.where(F.col("metric_name") == topic)
    total = lambda m: F.sum(F.when(F.col("metric") == m, F.col("sample_value")).otherwise(0))
    return (
        rows.groupBy(F.col("sampled_at").alias("ts"))
        .agg(*[total(m).alias(out) for out, m in names.items()])
        .orderBy("ts")
    )


def dashboard_throughput(samples, resolution: str, since: Column, topic: str | None = None):
    names = {"publish": "PUBLISH", "apply": "APPLY_JDBC"}
    return _wide(samples, resolution, since, names, topic)


def dashboard_lag(samples, resolution: str, since: Column, topic: str | None = None):
    names = {"jdbc": "LAG_JDBC", "iceberg": "LAG_ICEBERG"}
    return _wide(samples, resolution, since, names, topic)
