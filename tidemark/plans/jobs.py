"""Recovery, re-snapshot, unregistration and DDL decisions as jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.incremental import chunk_deletes, chunk_events, in_range
from tidemark.operators.reconcile import reconcile
from tidemark.operators.replay import from_scn, with_replay_counts
from tidemark.operators.state import change_rows
from tidemark.sinks import files
from tidemark.sinks.changelog import drop_changelog, ensure_changelog, scan_changelog, table_path
from tidemark.sinks.target import TargetTable
from tidemark.sources.envelopes import snapshot_load

STEP = "step_no int, step string, status string, detail string"


class Steps:
    """What a job did, as rows."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, str, str]] = []

    def add(self, step: str, status: str, detail: str = "") -> None:
        self.rows.append((len(self.rows) + 1, step, status, detail))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEP)


def deploy(spark: SparkSession, registry: DataFrame, changelog_root: str) -> DataFrame:
    """Create the changelogs that registered tables need; those that exist are kept.

    The registry is configuration, a row per registered table.
    """
    steps = Steps()
    tables = registry.select("schema_name", "table_name").distinct()
    for t in tables.orderBy("schema_name", "table_name").toLocalIterator():
        made = ensure_changelog(spark, changelog_root, t["schema_name"], t["table_name"])
        name = table_path("", t["schema_name"], t["table_name"]).rsplit("=", 1)[1]
        steps.add("changelog", "CREATED" if made else "KEPT", name)
    return steps.frame(spark)


def recover(
    spark: SparkSession,
    changelog_path: str,
    target: TargetTable,
    scn: int,
    since_ms: int | None = None,
    seq: str | None = None,
    go_live: bool = False,
) -> DataFrame:
    """Replay a changelog from a change number into a target.

    The apply step is the one the live stream uses. Only keys changed since
    ``scn`` come back; after a truncate the replay must start at the snapshot
    rows. One row per status, the first with the counters.
    """
    steps = Steps()
    try:
        events = from_scn(scan_changelog(spark, changelog_path), scn, since_ms)
        # Counted while the target is written, so the changelog is read once.
        counted, counts = with_replay_counts(events, target.keys)
        target.apply(change_rows(counted, seq), f"recovery-{scn}-{uuid.uuid4().hex[:8]}")
        found = counts.get
        steps.add("replay", "DONE", f"published={found['published']} skipped={found['skipped']}")
        steps.add("apply", "APPLIED")
        if go_live:
            steps.add("go-live", "LIVE")
    except Exception as e:
        steps.add("recovery", "FAILED", str(e).splitlines()[0])
        raise
    return steps.frame(spark)


def verify(source: DataFrame, target: TargetTable, columns: Sequence[str]) -> DataFrame:
    return reconcile(source, target.read(), columns)


def resnapshot(
    spark: SparkSession,
    source: DataFrame,
    target: TargetTable,
    schema: str,
    table: str,
    scn: int,
    ts_ms: int,
    mode: str = "INITIAL",
    truncate: bool = False,
    remaining_lag: int = 0,
) -> DataFrame:
    """Load a source table into its target again, step by step.

    The stream must be stopped and drained first. Truncating without loading
    data would leave the target empty, so that pair is refused. Without a
    truncate, rows deleted at the source during a gap stay behind as orphans.
    """
    if mode not in ("INITIAL", "NO_DATA"):
        raise ValueError(f"mode must be INITIAL or NO_DATA: {mode}")
    if mode == "NO_DATA" and truncate:
        raise ValueError("truncate needs a data load: NO_DATA would leave the target empty")
    steps = Steps()
    if remaining_lag > 0:
        steps.add("drain", "HOLD", f"remaining={remaining_lag}")
        return steps.frame(spark)
    steps.add("drain", "DONE")
    if truncate:
        target.truncate()
        rows = target.read().isEmpty()
        steps.add("truncate", "DONE" if rows else "FAILED")
    if mode == "INITIAL":
        events = snapshot_load(source, schema, table, scn, ts_ms)
        target.apply(change_rows(events), f"snapshot-{scn}")
        steps.add("load", "DONE")
    steps.add("live", "DONE", f"from scn {scn}")
    return steps.frame(spark)


def incremental_snapshot(
    spark: SparkSession,
    chunks: DataFrame,
    read_range: Callable[[Column], DataFrame],
    position: Callable[[], int],
    changes: Callable[[], DataFrame],
    target: TargetTable,
    key: str,
    schema: str,
    table: str,
    ts_ms: int,
    workspace: str,
) -> DataFrame:
    """Load a table into its target chunk by chunk while its changes go on being applied.

    ``chunks`` are planned ranges of ``key``; ``read_range`` reads the source
    where a condition holds, ``position`` tells the source's change number, and
    ``changes`` the change events so far. Of each chunk the rows are written to
    ``workspace`` between its low and its high number. Rows that the target has
    in the range and the source has not are deleted. A finished chunk is noted
    there, so a job that starts again goes on with the next one; a chunk taken
    twice does no harm. One row per chunk.
    """
    steps, root = Steps(), workspace.rstrip("/")
    done = set(files.numbered(spark, f"{root}/done"))
    for chunk in chunks.orderBy("chunk").toLocalIterator():
        n, name = chunk["chunk"], f"chunk-{chunk['chunk']}"
        if n in done:
            steps.add(name, "KEPT")
            continue
        here = in_range(key, chunk["lower"], chunk["upper"])
        low = position()
        read_range(here).write.mode("overwrite").parquet(f"{root}/{name}")
        high = position()
        rows = spark.read.parquet(f"{root}/{name}")
        window = (changes(), target.keys, low, high, ts_ms, schema, table)
        events = chunk_events(rows, *window)
        if target.exists():
            events = events.unionByName(chunk_deletes(target.read().where(here), rows, *window))
        target.apply(change_rows(events), f"{name}-{low}-{high}")
        files.write_text(spark, f"{root}/done/{n}.json", json.dumps({"low": low, "high": high}))
        files.remove(spark, f"{root}/{name}")
        steps.add(name, "DONE", f"low={low} high={high}")
    return steps.frame(spark)


def unregister(
    spark: SparkSession,
    registry: DataFrame,
    schema: str,
    table: str,
    changelog_root: str | None = None,
    drop: bool = False,
) -> DataFrame:
    """The registry without a table. Its changelog stays unless ``drop`` is set."""
    if drop and changelog_root:
        drop_changelog(spark, table_path(changelog_root, schema, table), purge=True)
    gone = (F.col("schema_name") == schema) & (F.col("table_name") == table)
    return registry.where(~gone)
