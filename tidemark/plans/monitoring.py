"""The monitoring chain: offsets to lags, samples, roll-ups and charts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import metrics as M
from tidemark.sinks import stores


def observe(
    topics: DataFrame, ends: DataFrame, commits: DataFrame, at: datetime
) -> DataFrame:
    """One observation per topic at one time."""
    lags = M.table_lags(topics, ends, commits)
    return lags.withColumn("sampled_at", F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"))


def ingest(
    spark: SparkSession,
    observations: DataFrame,
    store: str,
    now: datetime,
    resources: DataFrame | None = None,
) -> None:
    """Turn observations into stored samples, then roll up and purge as of ``now``.

    ``resources`` are samples of processes, of the shape of all samples.
    """
    samples = M.throughput_samples(observations)
    if resources is not None:
        samples = samples.select(*M.SAMPLE_COLUMNS).unionByName(resources.select(*M.SAMPLE_COLUMNS))
    stores.append_samples(samples, store)
    stores.roll_store(spark, store, now)


def dashboard(
    spark: SparkSession, store: str, resolution: str, hours: int, now: DataFrame | datetime,
    topic: str | None = None,
) -> dict[str, DataFrame]:
    """Throughput, lag and current resources for the last hours, at most as long as data is kept."""
    end = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    window = F.expr(f"interval {M.clamp_hours(resolution, hours)} hours")
    since = end - window
    recent = end - F.expr("interval 10 minutes")
    samples = stores.read_samples(spark, store, since)
    return {
        "throughput": M.dashboard_throughput(samples, resolution, since, topic),
        "lag": M.dashboard_lag(samples, resolution, since, topic),
        "resources": M.resources_now(stores.read_samples(spark, store, recent), recent),
    }
