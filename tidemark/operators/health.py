"""Connector health: state transitions and the events they cause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import effective_state, is_broken, status_trace
from tidemark.model import CONNECTOR_STATUS, SINK_PREFIX
from tidemark.operators.ordered import HOT_ROWS, previous
from tidemark.operators.routing import attribute


def read_status(polls: DataFrame, value: str = "value") -> DataFrame:
    """One row per connector and poll from the expanded status document."""
    shape = f"map<string, struct<status: {CONNECTOR_STATUS.simpleString()}>>"
    kept = [c for c in polls.columns if c != value]
    return polls.select(*kept, F.explode(F.from_json(value, shape)).alias("name", "_v")).select(
        *kept, "name", F.col("_v.status").alias("status")
    )


def with_state(observations: DataFrame) -> DataFrame:
    """Replace the status by its effective state and trace."""
    return observations.withColumns(
        {"state": effective_state(), "trace": status_trace()}
    ).drop("status")


def transition(state: Column, before: Column) -> Column:
    """CONNECTOR_FAILED, CONNECTOR_RECOVERED or null. Broken at first sight counts as failed."""
    was_broken = F.coalesce(is_broken(before), F.lit(False))
    return F.when(is_broken(state) & ~was_broken, "CONNECTOR_FAILED").when(
        ~is_broken(state) & was_broken, "CONNECTOR_RECOVERED"
    )


def health_events(
    states: DataFrame,
    key: str,
    order: Sequence[str],
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows at which a connector broke or recovered, with ``prev_state`` and ``event_type``."""
    rows = previous(states, [key], order, {"prev_state": "state"}, position, width, hot_rows)
    rows = rows.withColumn("event_type", transition(F.col("state"), F.col("prev_state")))
    return rows.where(F.col("event_type").isNotNull())


def health_timeline(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Health events as timeline rows of the tables they concern."""
    failed = F.col("event_type") == "CONNECTOR_FAILED"
    change = F.concat_ws(" → ", F.coalesce("prev_state", F.lit("-")), "state")
    first = F.concat_ws(" ", "name", F.lit("first seen as"), "state")
    return events.join(attribute(events, registry), "name").select(
        "observed_at",
        "schema_name",
        "table_name",
        "event_type",
        F.when(failed, "ERROR").otherwise("INFO").alias("severity"),
        F.when(F.col("prev_state").isNull(), first)
        .otherwise(F.concat_ws(" ", "name", change))
        .alias("message"),
        F.when(failed, F.col("trace")).alias("detail"),
    )


def sink_group(states: DataFrame, prefix: str = SINK_PREFIX) -> DataFrame:
    """One row: combined state of the table sinks and how many there are."""
    sinks = states.where(F.col("name").startswith(prefix))
    n = F.count(F.lit(1))
    bad = F.count_if(~F.col("state").isin("RUNNING", "PAUSED"))
    paused = F.count_if(F.col("state") == "PAUSED")
    group = F.when(n == 0, "none").when(bad > 0, "crit").when(paused > 0, "warn").otherwise("ok")
    return sinks.agg(group.alias("group_state"), n.alias("sinks"))
