"""Capture latency: from a change at the source to its event, as mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import millis_to_ntz, truncate_time

#: Size of a sketch: with 800 a rank is right to about half a percent.
SKETCH_K = 800


def latency_ms() -> Column:
    return F.col("ts_ms") - F.col("source.ts_ms")


def latency_sketches(events: DataFrame, keys: Sequence[Column | str] = (), k: int = SKETCH_K) -> DataFrame:
    """Per minute (of the event time) and key: n, max_ms and a sketch of the latencies.

    Events that lack one of the two times have no latency and are left out.
    Sketches of parts merge, so a minute with a third of all events is summed up
    where its events are.
    """
    timed = events.withColumn("_ms", latency_ms()).where("_ms IS NOT NULL")
    minute = millis_to_ntz(F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(60_000)))
    return timed.groupBy(minute.alias("at"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("_ms").alias("max_ms"), F.kll_sketch_agg_bigint("_ms", F.lit(k)).alias("sketch")
    )


def merge_latency(sketches: DataFrame, grain: str, keys: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches of finer buckets merged to hours or days; the events are not read again."""
    return sketches.groupBy(truncate_time(grain, "at").alias("at"), *keys).agg(
        F.sum("n").alias("n"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")
    )


def latency_quantiles(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The sketches' columns but the sketch, with a column ``p50``, ``p95``... for each share; the maximum is exact."""
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_")) for q in shares
    ])
