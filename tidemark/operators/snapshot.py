"""Initial-load progress from notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.scalars import strict_long
from tidemark.operators.ordered import running_sum
from tidemark.sources.messages import strings, unwrap

# The notification family followed here, and its known types.
AGGREGATE = "initial snapshot"
KNOWN_TYPES = ("STARTED", "IN_PROGRESS", "TABLE_SCAN_COMPLETED", "COMPLETED", "ABORTED")
CLOSING_TYPES = ("COMPLETED", "ABORTED")

_DATA = ("current_collection_in_progress", "scanned_collection", "total_rows_scanned", "status")
_NOTIFICATION = T.StructType(
    [
        *strings("aggregate_type", "type", "timestamp"),
        T.StructField("additional_data", T.StructType(strings(*_DATA))),
    ]
)


def read_notifications(
    messages: DataFrame, now_ms: Column, value: str = "value", seq: str = "seq"
) -> DataFrame:
    """Typed initial-load notifications; other families and bad JSON are skipped.

    Numbers may arrive as text. A missing time becomes ``now_ms``.
    """
    data = "_body.additional_data"
    return unwrap(messages, _NOTIFICATION, value).where(
        F.lower("_body.aggregate_type") == AGGREGATE
    ).select(
        seq,
        F.col("_body.type").alias("type"),
        F.coalesce(strict_long("_body.timestamp"), now_ms).alias("ts"),
        F.col(f"{data}.current_collection_in_progress").alias("current_table"),
        F.coalesce(f"{data}.scanned_collection", F.lit("?")).alias("scanned_table"),
        F.coalesce(strict_long(f"{data}.total_rows_scanned"), F.lit(0)).alias("scanned_rows"),
        F.coalesce(f"{data}.status", F.lit("?")).alias("scan_status"),
    )


def with_run(notifications: DataFrame, seq: str = "seq", width: int = 1_000_000) -> DataFrame:
    """Add ``run``: how many loads had started by then. Run 0 precedes the first start."""
    started = F.when(F.col("type") == "STARTED", 1).otherwise(0).cast("bigint")
    known = notifications.where(F.col("type").isin(*KNOWN_TYPES))
    return running_sum(known, [], [seq], started, "run", F.col(seq), width)


def snapshot_runs(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Where each load stood at its last notification."""
    kind = F.col("type")
    begun = F.min_by(F.col("ts"), F.when(~kind.isin(*CLOSING_TYPES), F.col(seq)))
    last = F.max_by(F.struct("type", "ts", "current_table"), F.col(seq))
    closed = F.col("_last.type").isin(*CLOSING_TYPES)
    return (
        runs.groupBy("run")
        .agg(last.alias("_last"), begun.alias("started_at_ms"))
        .select(
            "run",
            F.when(closed, F.col("_last.type")).otherwise("IN_PROGRESS").alias("phase"),
            F.when(F.col("_last.type") == "IN_PROGRESS", F.col("_last.current_table")).alias(
                "current_table"
            ),
            "started_at_ms",
            F.when(closed, F.col("_last.ts")).alias("completed_at_ms"),
        )
    )


def snapshot_tables(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows scanned per load and table; the last report of a table wins."""
    scans = runs.where(F.col("type") == "TABLE_SCAN_COMPLETED")
    return scans.groupBy("run", "scanned_table").agg(
        F.max_by("scanned_rows", seq).alias("scanned_rows")
    )


def snapshot_status(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: the last load with its table-to-rows map, as long as a load has tables."""
    last = runs.agg(F.max("run")).scalar()
    now = runs.where(F.col("run") == last)
    rows = F.map_from_entries(F.sort_array(F.collect_list(F.struct("scanned_table", "scanned_rows"))))
    tables = snapshot_tables(now, seq).groupBy("run").agg(rows.alias("tables"))
    return snapshot_runs(now, seq).join(tables, "run", "left")


def snapshot_timeline(notifications: DataFrame, seq: str = "seq") -> DataFrame:
    """Timeline rows that notifications cause; progress reports cause none."""
    kind = F.col("type")
    event = (
        F.when(kind == "STARTED", "SNAPSHOT_STARTED")
        .when(kind == "TABLE_SCAN_COMPLETED", "SNAPSHOT_TABLE_COMPLETED")
        .when(kind == "COMPLETED", "SNAPSHOT_COMPLETED")
        .when(kind == "ABORTED", "SNAPSHOT_ABORTED")
    )
    scan = F.format_string("%s scanned (%d rows, %s)", "scanned_table", "scanned_rows", "scan_status")
    return (
        notifications.withColumn("event_type", event)
        .where(F.col("event_type").isNotNull())
        .select(
            seq,
            "ts",
            "event_type",
            F.when(kind == "ABORTED", "WARN").otherwise("INFO").alias("severity"),
            F.when(kind == "TABLE_SCAN_COMPLETED", scan).alias("message"),
        )
    )
