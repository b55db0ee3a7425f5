"""Streaming queries of the pipeline.

Every consumer of a stream is a query of its own with its own checkpoint, so one
cannot delay the other and each resumes where it stopped. All sinks go through
``foreachBatch`` and are keyed by batch id or by change order, so a batch that is
delivered again has no further effect (the changelog may hold duplicates, which
every reader of it folds away).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import millis_to_ntz, ntz_micros, ntz_millis
from tidemark.model import DDL_EVENT
from tidemark.operators import ddl, health, snapshot
from tidemark.operators.metrics import AVG_METRICS, MAX_METRICS, SUM_METRICS, bucket_sums, bucket_values
from tidemark.operators.ordered import latest
from tidemark.operators.routing import exclude_paused
from tidemark.operators.state import change_rows, with_ingest_order
from tidemark.sinks.changelog import append_changelog
from tidemark.sinks.positions import low_water
from tidemark.sinks.stores import batches, merge_batches, prune_batches, read_batches, write_batch
from tidemark.sinks.target import TargetTable

COMMIT_INTERVAL = "60 seconds"
MINUTE_MS = 60_000


def message_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str
) -> DataFrame:
    """A stream of messages, from the first one on unless a checkpoint says otherwise."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def start(
    df: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str | None = None,
    interval: str | None = COMMIT_INTERVAL,
) -> StreamingQuery:
    """Run ``handle`` per micro-batch. Without an interval, take what is there and end."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


# --- change events: changelog and target -------------------------------------------


def _append(path: str, commit: str, seq: str | None, batch: DataFrame, batch_id: int) -> None:
    name = f"{commit}-{batch_id}"
    append_changelog(batch, path, name, cluster=False, commit_seq=batch_id, seq=seq)


def start_changelog(
    events: DataFrame, path: str, checkpoint: str, commit: str = "stream", seq: str | None = None, **kw
) -> StreamingQuery:
    """Append a stream to a changelog; ``seq`` names its offset column, if it has one."""
    return start(events, partial(_append, path, commit, seq), checkpoint, **kw)


def _apply(
    target: TargetTable, prefix: str, paused: DataFrame | None, seq: str | None,
    compact_every: int | None, batch: DataFrame, batch_id: int,
) -> None:
    if paused is not None:
        batch = exclude_paused(batch, paused)
    ordered = with_ingest_order(batch, batch_id, seq)
    target.apply(change_rows(ordered), f"{prefix}-{batch_id}")
    if compact_every and (batch_id + 1) % compact_every == 0:
        target.compact(only_if_due=True)


def expire(target: TargetTable, consumers: str, oldest: int | None = None) -> int | None:
    """Drop the tombstones that all consumers noted below ``consumers`` have passed, and unused folders.

    Without a known consumer nothing is dropped. ``oldest`` is the version of
    the target that the slowest reader still has open.
    """
    mark = low_water(target.spark, consumers)
    if mark is not None:
        target.compact(below=mark)
        target.vacuum(oldest)
    return mark


def start_apply(
    events: DataFrame,
    target: TargetTable,
    checkpoint: str,
    prefix: str = "live",
    paused: DataFrame | None = None,
    seq: str | None = None,
    compact_every: int | None = 60,
    **kw,
) -> StreamingQuery:
    """Apply a stream to a target. Stopping it pauses the table; starting it again catches up."""
    handle = partial(_apply, target, prefix, paused, seq, compact_every)
    return start(events, handle, checkpoint, **kw)


# --- schema changes ----------------------------------------------------------------


#: Schema changes are rare, so a long memory is a small state.
DDL_MEMORY = "30 days"


def _store_ddl(path: str, batch: DataFrame, batch_id: int) -> None:
    write_batch(batch.drop("_arrived"), path, batch_id)
    merge_batches(batch.sparkSession, path, DDL_EVENT, batch_id - 1)


def start_ddl(messages: DataFrame, path: str, checkpoint: str, memory: str = DDL_MEMORY, **kw) -> StreamingQuery:
    """Store each schema change once, by offset.

    A message that comes again within ``memory`` of its first arrival is dropped
    by the state store, which forgets older ones. Time is that of arrival, so no
    message is late, whatever its own time.
    """
    events = ddl.classify_ddl(ddl.parse_ddl(messages)).drop("is_snapshot")
    events = events.withColumns({"note": F.lit(None).cast("string"), "_arrived": F.current_timestamp()})
    fresh = events.withWatermark("_arrived", memory).dropDuplicatesWithinWatermark(["kafka_offset"])
    return start(fresh, partial(_store_ddl, path), checkpoint, **kw)


def ddl_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored schema changes; of an offset read again after a lost checkpoint one row counts."""
    return read_batches(spark, path, DDL_EVENT).dropDuplicates(["kafka_offset"])


# --- connector health --------------------------------------------------------------

STATE_ROW = T.StructType(
    [T.StructField("observed_at", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ("name", "state", "trace")]
)
HEALTH_EVENT = T.StructType(
    STATE_ROW.fields + [T.StructField(c, T.StringType()) for c in ("prev_state", "event_type")]
)


def _last_states(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    folders = batches(spark, f"{path}/last", before=batch_id)
    if not folders:
        return spark.createDataFrame([], STATE_ROW)
    return spark.read.schema(STATE_ROW).parquet(folders[-1])


def _watch(path: str, batch: DataFrame, batch_id: int) -> None:
    """Transitions of this batch against the last known states, then the new last states.

    A poll that is no later than the known one of its connector has been
    overtaken and tells nothing; of polls at one time one counts.
    """
    columns = STATE_ROW.fieldNames()
    known = _last_states(batch.sparkSession, path, batch_id).withColumn("_known", F.lit(True))
    last = known.select("name", F.col("observed_at").alias("_last"))
    seen = latest(
        batch.select(*columns).join(last, "name", "left")
        .where(F.col("_last").isNull() | (F.col("observed_at") > F.col("_last"))),
        ["name", "observed_at"],
        [F.col("state").desc_nulls_last(), F.col("trace").desc_nulls_last()],
    ).select(*columns, F.lit(False).alias("_known"))
    rows = known.unionByName(seen)
    found = health.health_events(
        rows.withColumn("_at", ntz_millis("observed_at")),
        "name", ["observed_at"], F.col("_at"), MINUTE_MS,
    )
    write_batch(
        found.where(~F.col("_known")).select(*HEALTH_EVENT.fieldNames()), f"{path}/events", batch_id
    )
    newest = latest(rows, ["name"], [F.col("observed_at").desc()])
    write_batch(newest.select(*columns), f"{path}/last", batch_id)
    prune_batches(batch.sparkSession, f"{path}/last", batch_id)
    merge_batches(batch.sparkSession, f"{path}/events", HEALTH_EVENT, batch_id - 1)


def start_health(states: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Follow connector states (observed_at, name, state, trace) and store transitions."""
    return start(states, partial(_watch, path), checkpoint, **kw)


def health_log(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/events", HEALTH_EVENT)


# --- snapshot progress -------------------------------------------------------------

NOTE_ROW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("current_table", T.StringType()),
        T.StructField("scanned_table", T.StringType()),
        T.StructField("scanned_rows", T.LongType()),
        T.StructField("scan_status", T.StringType()),
    ]
)


def _follow(path: str, batch: DataFrame, batch_id: int) -> None:
    """Keep of the newest load only the notifications its status depends on."""
    spark = batch.sparkSession
    folders = batches(spark, path, before=batch_id)
    known = (
        spark.read.schema(NOTE_ROW).parquet(folders[-1])
        if folders
        else spark.createDataFrame([], NOTE_ROW)
    )
    columns = NOTE_ROW.fieldNames()
    rows = snapshot.with_run(known.unionByName(batch.select(*columns)))
    newest = rows.where(F.col("run") == rows.agg(F.max("run")).scalar())
    open_seq = F.when(~F.col("type").isin(*snapshot.CLOSING_TYPES), F.col("seq"))
    bounds = newest.agg(F.min(open_seq).alias("lo"), F.max("seq").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    scans = latest(
        newest.where(F.col("type") == "TABLE_SCAN_COMPLETED"),
        ["scanned_table"],
        [F.col("seq").desc()],
    )
    ends = newest.where((F.col("seq") == lo) | (F.col("seq") == hi))
    kept = scans.unionByName(ends).select(*columns).dropDuplicates(["seq"])
    write_batch(kept, path, batch_id)
    prune_batches(spark, path, batch_id)


def start_snapshot_progress(notes: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Follow typed notifications (see ``read_notifications``)."""
    return start(notes, partial(_follow, path), checkpoint, **kw)


def snapshot_progress(spark: SparkSession, path: str) -> DataFrame:
    folders = batches(spark, path)
    rows = spark.read.schema(NOTE_ROW).parquet(folders[-1])
    return snapshot.snapshot_status(snapshot.with_run(rows)).drop("run")


# --- metrics -----------------------------------------------------------------------


def _window_rollup(samples: DataFrame, at: Column, length: str) -> DataFrame:
    value, value2 = bucket_values()
    return (
        samples.groupBy(F.window(at, length), "metric", "metric_name").agg(*bucket_sums())
        .select("window", "metric", "metric_name", value.alias("sample_value"), value2.alias("sample_value2"))
    )


def rollup_stream(samples: DataFrame, grain: str = "HOUR", lateness: str = "5 minutes") -> DataFrame:
    """HOUR or DAY samples out of a stream of MIN samples, by the rules of the batch roll-up.

    A day is rolled up from its hours in the same query: two aggregations follow
    one another, and the watermark passes through both. A bucket is emitted
    once, when the watermark has passed it; samples that come later are dropped,
    as they are by the batch roll-up. Samples without a ``resolution`` are
    MIN, those without a ``sample_value2`` have none. A watermark needs zoned
    times, so samples are read as UTC.
    """
    if grain not in ("HOUR", "DAY"):
        raise ValueError(f"grain must be HOUR or DAY: {grain}")
    if "resolution" in samples.columns:
        samples = samples.where(F.col("resolution") == "MIN")
    if "sample_value2" not in samples.columns:
        samples = samples.withColumn("sample_value2", F.lit(None).cast("bigint"))
    rows = (
        samples.where(F.col("metric").isin(*SUM_METRICS, *MAX_METRICS, *AVG_METRICS))
        .withColumn("at", F.timestamp_micros(ntz_micros("sampled_at")))
        .withWatermark("at", lateness)
    )
    rolled = _window_rollup(rows, F.col("at"), "1 hour")
    if grain == "DAY":
        rolled = _window_rollup(rolled, F.window_time("window"), "1 day")
    return rolled.select(
        millis_to_ntz(F.unix_millis("window.start")).alias("sampled_at"),
        "metric", "metric_name", "sample_value", "sample_value2", F.lit(grain).alias("resolution"),
    )
