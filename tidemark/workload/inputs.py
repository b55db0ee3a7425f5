"""Inputs of the registered queries, derived by Spark from the given tables.

Each relation has an SQL twin of the same shape (the upper-case constants).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import ntz_millis
from tidemark.operators.ordered import previous

SCN_WIDTH = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- change events from `events` ----------------------------------------------
# key id = user_id, change number = event_id, one table per event type.

_OP = {"signup": "c", "view": "r", "error": "d"}

OPS = """
  SELECT event_id, user_id AS id, CAST(event_id AS VARCHAR) AS scn,
         'tx-' || CAST(event_id // 5 AS VARCHAR) AS tx_id,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r'
                         WHEN 'error' THEN 'd' ELSE 'u' END AS op,
         CAST(value AS DECIMAL(14,2)) AS amt, event_type AS st,
         epoch_us(ts) // 1000 AS ts_ms
  FROM events
"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.lit("u")
    for name, code in _OP.items():
        op = F.when(kind == name, code).otherwise(op)
    return e.select(
        "event_id",
        F.col("user_id").alias("id"),
        F.col("event_id").cast("string").alias("scn"),
        F.concat(F.lit("tx-"), F.expr("event_id div 5").cast("string")).alias("tx_id"),
        op.alias("op"),
        F.col("value").cast("decimal(14,2)").alias("amt"),
        kind.alias("st"),
        ntz_millis("ts").alias("ts_ms"),
    )


def _events(rows: DataFrame, before) -> DataFrame:
    image = F.struct(F.col("id").alias("ID"), F.col("amt").alias("AMT"), F.col("st").alias("ST"))
    return rows.select(
        "event_id",
        "op",
        before.alias("before"),
        F.when(F.col("op") != "d", image).alias("after"),
        F.struct(
            F.col("scn"),
            F.col("tx_id").alias("txId"),
            F.col("ts_ms"),
            F.lit("CDC").alias("schema"),
            F.upper("st").alias("table"),
        ).alias("source"),
        "ts_ms",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events whose deletes carry the deleted row; updates carry no old image."""
    return as_changes(ops(spark, sf_dir))


def as_changes(rows: DataFrame) -> DataFrame:
    own = F.struct(F.col("id").alias("ID"), F.col("amt").alias("AMT"), F.col("st").alias("ST"))
    return _events(rows, F.when(F.col("op") == "d", own))


def full_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events whose updates and deletes carry the key's image before them."""
    rows = previous(
        ops(spark, sf_dir), ["id"], ["event_id"], {"_amt": "amt", "_st": "st"},
        F.col("event_id"), SCN_WIDTH, present="_has",
    )
    image = F.struct(F.col("id").alias("ID"), F.col("_amt").alias("AMT"), F.col("_st").alias("ST"))
    return _events(rows, F.when(F.col("_has") & F.col("op").isin("u", "d"), image))


# --- metric samples from `events` ----------------------------------------------

SAMPLES = """
  SELECT ts AS sampled_at,
         CASE event_type WHEN 'click' THEN 'PUBLISH' WHEN 'purchase' THEN 'APPLY_JDBC'
                         WHEN 'view' THEN 'LAG_JDBC' WHEN 'signup' THEN 'LAG_ICEBERG'
                         ELSE 'RESOURCE' END AS metric,
         'T' || CAST(user_id % 20 AS VARCHAR) AS metric_name,
         CAST(round(value * 100) AS BIGINT) AS sample_value,
         CASE WHEN event_type = 'error' AND user_id % 3 > 0 THEN user_id END AS sample_value2,
         'MIN' AS resolution
  FROM events
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    metric = F.lit("RESOURCE")
    names = {
        "click": "PUBLISH", "purchase": "APPLY_JDBC", "view": "LAG_JDBC", "signup": "LAG_ICEBERG",
    }
    for event, name in names.items():
        metric = F.when(kind == event, name).otherwise(metric)
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("sampled_at"),
        metric.alias("metric"),
        F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("metric_name"),
        F.round(F.col("value") * 100).cast("bigint").alias("sample_value"),
        F.when((kind == "error") & (F.col("user_id") % 3 > 0), F.col("user_id")).alias(
            "sample_value2"
        ),
        F.lit("MIN").alias("resolution"),
    )


# --- connector states from `events` ---------------------------------------------

POLLS = """
  SELECT event_id, ts AS observed_at,
         'dz-jdbc-sink-cdc_user_' || CAST(user_id AS VARCHAR) AS name,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'UNKNOWN'
                         WHEN 'view' THEN 'PAUSED' ELSE 'RUNNING' END AS state,
         CASE event_type WHEN 'error' THEN
           'Task failed' || chr(10) || 'Caused by: first' || chr(10) ||
           'Caused by: event ' || CAST(event_id AS VARCHAR) || ' ' END AS trace
  FROM events
"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status documents of one connector each, as the runtime would report them."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    name = F.concat(F.lit("dz-jdbc-sink-cdc_user_"), F.col("user_id").cast("string"))
    trace = F.concat(
        F.lit("Task failed\nCaused by: first\nCaused by: event "),
        F.col("event_id").cast("string"),
        F.lit(" "),
    )
    own = F.when(kind == "view", "PAUSED").when(kind != "signup", "RUNNING")
    task = F.struct(
        F.lit(0).alias("id"),
        F.when(kind == "error", "FAILED").otherwise("RUNNING").alias("state"),
        F.when(kind == "error", trace).alias("trace"),
    )
    status = F.struct(F.struct(own.alias("state")).alias("connector"), F.array(task).alias("tasks"))
    document = F.to_json(F.create_map(name, F.struct(status.alias("status"))))
    return e.select("event_id", F.col("ts").alias("observed_at"), document.alias("value"))


# --- snapshot notifications from `events` ----------------------------------------

NOTES = """
  SELECT event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'click' THEN 'IN_PROGRESS'
                         WHEN 'view' THEN 'TABLE_SCAN_COMPLETED' WHEN 'purchase' THEN 'COMPLETED'
                         ELSE 'ABORTED' END AS type,
         epoch_us(ts) // 1000 AS ts,
         'CDC.U' || CAST(user_id AS VARCHAR) AS tab,
         CAST(round(value * 100) AS BIGINT) AS n
  FROM events
"""


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notification messages, every second one wrapped in ``{schema, payload}``."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    types = {
        "signup": "STARTED", "click": "IN_PROGRESS", "view": "TABLE_SCAN_COMPLETED",
        "purchase": "COMPLETED",
    }
    phase = F.lit("ABORTED")
    for event, name in types.items():
        phase = F.when(kind == event, name).otherwise(phase)
    tab = F.concat(F.lit("CDC.U"), F.col("user_id").cast("string"))
    data = F.struct(
        F.when(kind == "click", tab).alias("current_collection_in_progress"),
        F.when(kind == "view", tab).alias("scanned_collection"),
        F.when(kind == "view", F.round(F.col("value") * 100).cast("bigint").cast("string")).alias(
            "total_rows_scanned"
        ),
        F.when(kind == "view", "SUCCEEDED").alias("status"),
    )
    body = F.to_json(
        F.struct(
            F.lit("Initial Snapshot").alias("aggregate_type"),
            phase.alias("type"),
            data.alias("additional_data"),
            ntz_millis("ts").alias("timestamp"),
        )
    )
    wrapped = F.concat(F.lit('{"schema":{},"payload":'), body, F.lit("}"))
    value = F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(body)
    return e.select(F.col("event_id").alias("seq"), value.alias("value"))


# --- schema changes from `part` ----------------------------------------------------
# One message per part; its table is CDC.P<size>.

DDL_TEXT = """
  SELECT p_partkey AS kafka_offset, 'P' || CAST(p_size AS VARCHAR) AS tab,
         CASE p_type WHEN 'ECONOMY' THEN '  grant SELECT on CDC.P' || CAST(p_size AS VARCHAR) || ' to X'
                     WHEN 'SMALL' THEN 'ALTER TABLE CDC.P' || CAST(p_size AS VARCHAR) || ' ADD SUPPLEMENTAL LOG DATA'
                     ELSE 'ALTER TABLE "CDC"."P' || CAST(p_size AS VARCHAR) || '" ADD (C' ||
                          CAST(p_partkey AS VARCHAR) || ' NUMBER) -- not cdc.P' || CAST(p_size AS VARCHAR) || '0'
         END AS ddl_text,
         p_brand = 'Brand#1' AS is_snapshot
  FROM part
"""


def ddl_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    tab = F.concat(F.lit("P"), size)
    text = (
        F.when(
            F.col("p_type") == "ECONOMY", F.concat(F.lit("  grant SELECT on CDC."), tab, F.lit(" to X"))
        )
        .when(
            F.col("p_type") == "SMALL",
            F.concat(F.lit("ALTER TABLE CDC."), tab, F.lit(" ADD SUPPLEMENTAL LOG DATA")),
        )
        .otherwise(
            F.concat(
                F.lit('ALTER TABLE "CDC"."'), tab, F.lit('" ADD (C'),
                F.col("p_partkey").cast("string"), F.lit(" NUMBER) -- not cdc."), tab, F.lit("0"),
            )
        )
    )
    source = F.struct(
        F.when(F.col("p_brand") == "Brand#1", "true").otherwise("false").alias("snapshot"),
        (F.col("p_partkey") * 10).cast("string").alias("scn"),
    )
    change = F.struct(F.concat(F.lit('"CDC"."'), tab, F.lit('"')).alias("id"))
    body = F.to_json(
        F.struct(
            source.alias("source"),
            (F.col("p_partkey") + 1_700_000_000_000).alias("ts_ms"),
            text.alias("ddl"),
            F.array(change).alias("tableChanges"),
        )
    )
    return p.select(
        F.col("p_partkey").alias("kafka_offset"),
        F.concat(F.lit('{"payload":'), body, F.lit("}")).alias("value"),
    )


# --- registry: one registered table per part size up to 40 ---------------------------

REGISTRY = """
  SELECT DISTINCT 'CDC' AS schema_name, 'P' || CAST(p_size AS VARCHAR) AS table_name,
         CASE WHEN p_size % 2 = 0 THEN 'TGT' ELSE 'CDC' END AS target_schema,
         'P' || CAST(p_size AS VARCHAR) AS target_table
  FROM part WHERE p_size <= 40
"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("P"), F.col("p_size").cast("string"))
    return (
        table(spark, sf_dir, "part")
        .where("p_size <= 40")
        .select(
            F.lit("CDC").alias("schema_name"),
            name.alias("table_name"),
            F.when(F.col("p_size") % 2 == 0, "TGT").otherwise("CDC").alias("target_schema"),
            name.alias("target_table"),
        )
        .distinct()
    )
