"""Replay of a changelog from a change number on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.functions.connect import connect_key, connect_value, key_image
from tidemark.functions.scalars import scn_long
from tidemark.model import DAY_MS


def from_scn(events: DataFrame, scn: int, since_ms: int | None = None) -> DataFrame:
    """Events at or past ``scn``; a change number that is no number drops the row.

    On a stored changelog the cut uses ``scn_num``, which reaches the Parquet
    scan, and ``since_ms`` prunes day partitions before it.
    """
    number = F.col("scn_num") if "scn_num" in events.columns else scn_long("source.scn")
    if since_ms is not None and "p_ts_ms" in events.columns:
        events = events.where(F.col("p_ts_ms") >= since_ms - since_ms % DAY_MS)
    return events.where(number >= scn)


def replay_order(events: DataFrame, tie: Sequence[str] | None = None) -> DataFrame:
    """Global order: change number, then transaction as text, then the tie columns.

    Those are by default the order of arrival where it is stored, else the event
    time. A range sort, so a key or transaction of any size is spread over tasks.
    """
    if tie is None:
        stored = {"commit_seq", "ingest_seq"} <= set(events.columns)
        tie = ("commit_seq", "ingest_seq") if stored else ("ts_ms",)
    number = F.col("scn_num") if "scn_num" in events.columns else scn_long("source.scn")
    return events.orderBy(
        number.asc_nulls_last(), F.coalesce(F.col("source.txId"), F.lit("")), *tie
    )


_STORAGE = ("scn_num", "commit_id", "p_ts_ms", "commit_seq", "ingest_seq")


def messages(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key and value messages of events; events without an image are left out."""
    events = events.drop(*_STORAGE)
    shape = events.schema
    return events.where(key_image(shape).isNotNull()).select(
        connect_key(shape, keys).alias("key"), connect_value(shape).alias("value")
    )


def replay_counts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many events a replay publishes and how many it skips.

    With ``keys`` the images are judged by their first key column, which is never
    null in an image; the scan then reads that one column of them.
    """
    return events.agg(*_counters(events, keys))


def with_replay_counts(events: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """The events, and their ``replay_counts`` once the events have been read by one job."""
    counts = Observation()
    return events.observe(counts, *_counters(events, keys)), counts


def _counters(events: DataFrame, keys: Sequence[str]) -> list[Column]:
    image = key_image(events.schema)
    if keys:
        image = F.coalesce(f"after.{keys[0]}", f"before.{keys[0]}")
    skipped = F.count_if(image.isNull())
    return [(F.count(F.lit(1)) - skipped).alias("published"), skipped.alias("skipped")]


def publish(events: DataFrame, keys: Sequence[str], path: str, fmt: str = "json") -> None:
    """Write key and value messages to files in replay order.

    Part files are numbered in range order, so reading them by name gives the
    replay order back.
    """
    messages(replay_order(events), keys).write.format(fmt).mode("append").save(path)
