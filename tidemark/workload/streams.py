"""Structured Streaming over the given tables.

The stream source is the ``events`` or ``part`` table as a file stream, read to
its end. Results are read from what the stream wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import ntz_millis, truncate_time
from tidemark.model import DDL_EVENT
from tidemark.operators import health, snapshot
from tidemark.plans import jobs
from tidemark.session import shared_dir
from tidemark.sinks import changelog as log
from tidemark.sinks.stores import read_batches
from tidemark.sinks.target import TargetTable
from tidemark.streaming import queries as S
from tidemark.workload import query
from tidemark.workload import changes as ch, control, inputs
from tidemark.workload.inputs import table


class _StreamTables:
    """Stands in for a session where inputs read a table: the table comes as a stream."""

    def __init__(self, spark):
        self.spark, self.read = spark, self

    def parquet(self, path: str):
        schema = self.spark.read.parquet(path).schema
        folder, name = path.rsplit("/", 1)
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", name)
        return reader.parquet(folder)


def _run(start, *args, **kw):
    q = start(*args, interval=None, **kw)
    q.awaitTermination()


@query(ch.STATE)
def stream_apply(spark, sf_dir):
    """Two consumers of one stream: the target, and a changelog it could be rebuilt from."""
    work = shared_dir(spark, "stream")
    live, rebuilt = (TargetTable(spark, f"{work}/{name}", ch.KEYS) for name in ("target", "rebuilt"))
    events = inputs.changes(_StreamTables(spark), sf_dir)
    path = log.table_path(work, "CDC", "USERS")
    both = [
        S.start_apply(events, live, f"{work}/cp-apply", seq="event_id", interval=None),
        S.start_changelog(events, path, f"{work}/cp-changelog", seq="event_id", interval=None),
    ]
    for q in both:
        q.awaitTermination()
    jobs.recover(spark, path, rebuilt, 0)
    # Where both agree a row comes out once.
    return ch._flat(live.read()).unionByName(ch._flat(rebuilt.read())).distinct()


@query(ch.DAYS)
def stream_changelog(spark, sf_dir):
    work = shared_dir(spark, "stream")
    path = log.table_path(work, "CDC", "USERS")
    events = inputs.changes(_StreamTables(spark), sf_dir).drop("event_id")
    _run(S.start_changelog, events, path, f"{work}/cp-changelog")
    days = log.changelog_partitions(log.scan_changelog(spark, path))
    return days.select("day", "records")


@query(control._CLASSIFIED)
def stream_ddl(spark, sf_dir):
    """Messages that come twice, in several micro-batches and across a restart, are stored once."""
    work = shared_dir(spark, "stream")
    messages = inputs.ddl_messages(spark, sf_dir)

    def follow():
        stream = S.message_stream(spark, f"{work}/topic", messages.schema, "parquet", maxFilesPerTrigger="1")
        _run(S.start_ddl, stream, f"{work}/ddl", f"{work}/cp-ddl")

    messages.unionByName(messages).repartition(3, F.col("kafka_offset") % 7).write.parquet(f"{work}/topic")
    follow()
    messages.coalesce(1).write.mode("append").parquet(f"{work}/topic")
    follow()
    # Read without the reader's own guard against a lost checkpoint.
    return read_batches(spark, f"{work}/ddl", DDL_EVENT).drop("note")


@query(control.TRANSITIONS + "SELECT name, state, prev_state, event_type, count(*) AS n FROM x GROUP BY ALL")
def stream_health(spark, sf_dir):
    work = shared_dir(spark, "stream")
    states = health.with_state(health.read_status(inputs.polls(_StreamTables(spark), sf_dir)))
    _run(S.start_health, states, f"{work}/health", f"{work}/cp-health")
    found = S.health_log(spark, f"{work}/health")
    return found.groupBy("name", "state", "prev_state", "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    control.RUNS
    + """, z AS (SELECT * FROM r WHERE run = (SELECT max(run) FROM r)),
    l AS (SELECT max_by(type, seq) AS type, max_by(ts, seq) AS ts, max_by(tab, seq) AS tab,
            min_by(ts, CASE WHEN type NOT IN ('COMPLETED','ABORTED') THEN seq END) AS begun FROM z),
    t AS (SELECT tab, max_by(n, seq) AS n FROM z WHERE type = 'TABLE_SCAN_COMPLETED' GROUP BY tab)
    SELECT CASE WHEN type IN ('COMPLETED','ABORTED') THEN type ELSE 'IN_PROGRESS' END AS phase,
           CASE WHEN type = 'IN_PROGRESS' THEN tab END AS current_table, begun AS started_at_ms,
           CASE WHEN type IN ('COMPLETED','ABORTED') THEN ts END AS completed_at_ms,
           (SELECT count(*) FROM t) AS n_tables,
           CAST(coalesce((SELECT sum(n) FROM t), 0) AS BIGINT) AS n_rows FROM l"""
)
def stream_snapshot_progress(spark, sf_dir):
    work = shared_dir(spark, "stream")
    notes = snapshot.read_notifications(
        inputs.notifications(_StreamTables(spark), sf_dir), F.lit(0).cast("bigint")
    )
    _run(S.start_snapshot_progress, notes, f"{work}/progress", f"{work}/cp-progress")
    rows = F.aggregate(F.map_values("tables"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return S.snapshot_progress(spark, f"{work}/progress").select(
        "phase",
        "current_table",
        "started_at_ms",
        "completed_at_ms",
        F.coalesce(F.size("tables"), F.lit(0)).cast("bigint").alias("n_tables"),
        F.coalesce(rows, F.lit(0)).alias("n_rows"),
    )


_VALUES = """CASE WHEN metric IN ('PUBLISH', 'APPLY_JDBC') THEN sum(sample_value)
              WHEN metric LIKE 'LAG%' THEN max(sample_value) ELSE CAST(round(CAST(sum(sample_value) AS DECIMAL(38,10)) / count(sample_value)) AS BIGINT) END"""
_VALUES2 = """CASE WHEN metric = 'RESOURCE' AND count(sample_value2) > 0 THEN
              CAST(round(CAST(sum(sample_value2) AS DECIMAL(38,10)) / count(sample_value2)) AS BIGINT) END"""


def _rolled_sql(source: str, unit: str) -> str:
    return f"""SELECT date_trunc('{unit}', sampled_at) AS sampled_at, metric, metric_name,
        CAST({_VALUES} AS BIGINT) AS sample_value, {_VALUES2} AS sample_value2
      FROM {source} GROUP BY 1, 2, 3
      HAVING date_trunc('{unit}', sampled_at) + INTERVAL 1 {unit} <= (SELECT max(sampled_at) - INTERVAL 5 MINUTE FROM s)"""


@query(
    f"""WITH s AS ({inputs.SAMPLES}), hours AS ({_rolled_sql("s", "hour")}), days AS ({_rolled_sql("hours", "day")})
    SELECT *, 'HOUR' AS resolution FROM hours UNION ALL SELECT *, 'DAY' FROM days"""
)
def stream_rollup(spark, sf_dir):
    """Closed hours and days of all metrics; files come one per trigger, the watermark closes the buckets."""
    work = shared_dir(spark, "stream")
    samples = inputs.samples(spark, sf_dir)
    seconds = F.unix_seconds(F.col("sampled_at").cast("timestamp"))
    ends = samples.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    part = F.floor((seconds - ends.a) * 3 / (ends.b - ends.a + 1))
    for n in range(3):
        samples.where(part == n).coalesce(1).write.mode("append").parquet(f"{work}/samples")
    for grain in ("HOUR", "DAY"):
        stream = S.message_stream(spark, f"{work}/samples", samples.schema, "parquet", maxFilesPerTrigger="1")
        rolled = S.rollup_stream(stream, grain)
        out = rolled.writeStream.format("parquet").option("path", f"{work}/{grain}")
        q = out.option("checkpointLocation", f"{work}/cp-{grain}").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(rolled.schema).parquet(f"{work}/HOUR").unionByName(
        spark.read.schema(rolled.schema).parquet(f"{work}/DAY")
    )
