"""The event timeline of tables, and other newest-first lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timeline(
    events: DataFrame,
    table: tuple[str, str] | None = None,
    severity: str | None = None,
    text: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Newest events, optionally of one table, one severity, or a name containing a text."""
    if table is not None:
        events = events.where(
            (F.col("schema_name") == table[0]) & (F.col("table_name") == table[1])
        )
    if severity is not None:
        events = events.where(F.col("severity") == severity)
    if text:
        name = F.lower(F.concat_ws(".", "schema_name", "table_name"))
        events = events.where(name.contains(text.lower()))
    events = events.orderBy(F.col("event_id").desc())
    return events if limit is None else events.limit(limit)


def recovery_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc())


def registered_tables(registry: DataFrame) -> DataFrame:
    return registry.orderBy("schema_name", "table_name")


def target_schemas(registry: DataFrame) -> DataFrame:
    """Distinct schemas written to."""
    return registry.select(F.coalesce("target_schema", "schema_name").alias("target_schema")).distinct()
