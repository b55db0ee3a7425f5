"""Health, snapshot progress, schema changes, the timeline."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.scalars import ntz_millis
from tidemark.functions.text import cause_line, first_line
from tidemark.operators import ddl, health, snapshot
from tidemark.operators.metrics import MINUTE_MS
from tidemark.operators.routing import attribute, exclude_paused
from tidemark.operators.timeline import target_schemas, timeline
from tidemark.plans import decisions
from tidemark.session import shared_dir
from tidemark.workload import query
from tidemark.workload.inputs import (
    DDL_TEXT, NOTES, POLLS, REGISTRY, changes, ddl_messages, notifications, polls,
    registry, table,
)

# --- connector health -----------------------------------------------------------------


def _states(spark, sf_dir):
    return health.with_state(health.read_status(polls(spark, sf_dir)))


@query(
    f"""SELECT event_id, name, state,
      CASE WHEN trace IS NOT NULL THEN 'event ' || CAST(event_id AS VARCHAR) END AS cause
      FROM ({POLLS})"""
)
def connector_states(spark, sf_dir):
    return _states(spark, sf_dir).select(
        "event_id", "name", "state", cause_line("trace").alias("cause")
    )


TRANSITIONS = f"""
  WITH s AS ({POLLS}), p AS (
    SELECT *, lag(state) OVER (PARTITION BY name ORDER BY observed_at) AS prev FROM s),
  f AS (SELECT *, state IN ('FAILED','UNKNOWN') AS bad,
               coalesce(prev IN ('FAILED','UNKNOWN'), false) AS was_bad FROM p),
  x AS (SELECT event_id, name, state, prev AS prev_state,
          CASE WHEN bad THEN 'CONNECTOR_FAILED' ELSE 'CONNECTOR_RECOVERED' END AS event_type
        FROM f WHERE bad <> was_bad)
"""


def _health(spark, sf_dir):
    return health.health_events(
        _states(spark, sf_dir).withColumn("at", ntz_millis("observed_at")),
        "name", ["at", "event_id"], F.col("at"), MINUTE_MS,
    )


@query(TRANSITIONS + "SELECT * FROM x")
def health_events(spark, sf_dir):
    return _health(spark, sf_dir).select("event_id", "name", "state", "prev_state", "event_type")


def _user_registry(spark, sf_dir):
    """Users with an order have a registered table; one table is called like an ending of others."""
    users = table(spark, sf_dir, "orders").select(
        F.lit("CDC").alias("schema_name"),
        F.concat(F.lit("USER_"), F.col("o_custkey").cast("string")).alias("table_name"),
    )
    return users.distinct()


@query(
    TRANSITIONS
    + """, r AS (SELECT DISTINCT 'cdc_user_' || CAST(o_custkey AS VARCHAR) AS suffix,
                        'USER_' || CAST(o_custkey AS VARCHAR) AS tab FROM orders)
    SELECT coalesce(CASE WHEN r.tab IS NOT NULL THEN 'CDC' END, '-') AS schema_name,
           coalesce(r.tab, x.name) AS table_name, event_type,
           CASE WHEN event_type = 'CONNECTOR_FAILED' THEN 'ERROR' ELSE 'INFO' END AS severity,
           count(*) AS n
    FROM x LEFT JOIN r ON x.name = 'dz-jdbc-sink-' || r.suffix GROUP BY 1, 2, 3, 4"""
)
def health_timeline(spark, sf_dir):
    rows = health.health_timeline(_health(spark, sf_dir), _user_registry(spark, sf_dir))
    return rows.groupBy("schema_name", "table_name", "event_type", "severity").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """WITH t AS (SELECT DISTINCT 'S' || CAST(c_nationkey AS VARCHAR) AS s, 'T' || CAST(c_custkey % 50 AS VARCHAR) AS t
                  FROM customer),
    n AS (SELECT 'sink-s' || CAST(c_nationkey AS VARCHAR) || '_t' || CAST(c_custkey % 70 AS VARCHAR) AS name FROM customer
          UNION SELECT 'x-' || CAST(c_custkey AS VARCHAR) || '_s1_t5' FROM customer),
    m AS (SELECT n.name, min(t.s || '.' || t.t) AS best FROM n LEFT JOIN t
          ON ends_with(n.name, lower(t.s || '_' || t.t)) GROUP BY n.name)
    SELECT name, coalesce(split_part(best, '.', 1), '-') AS schema_name,
           coalesce(split_part(best, '.', 2), name) AS table_name FROM m"""
)
def connector_tables(spark, sf_dir):
    """Connector names against registered tables by their ending."""
    c = table(spark, sf_dir, "customer")
    text = lambda e: F.expr(e).cast("string")
    tables = c.select(
        F.concat(F.lit("S"), text("c_nationkey")).alias("schema_name"),
        F.concat(F.lit("T"), text("c_custkey % 50")).alias("table_name"),
    ).distinct()
    own = F.concat(F.lit("sink-s"), text("c_nationkey"), F.lit("_t"), text("c_custkey % 70"))
    other = F.concat(F.lit("x-"), text("c_custkey"), F.lit("_s1_t5"))
    names = c.select(F.explode(F.array(own, other)).alias("name"))
    return attribute(names, tables)


@query(
    f"""WITH s AS ({POLLS}), l AS (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id DESC) AS rn FROM s)
    SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN count_if(state NOT IN ('RUNNING','PAUSED')) > 0 THEN 'crit'
                WHEN count_if(state = 'PAUSED') > 0 THEN 'warn' ELSE 'ok' END AS group_state,
           count(*) AS sinks FROM l WHERE rn = 1"""
)
def sink_group(spark, sf_dir):
    from tidemark.operators.ordered import latest

    now = latest(_states(spark, sf_dir), ["name"], [F.col("event_id").desc()])
    return health.sink_group(now)


# --- snapshot progress -------------------------------------------------------------------

RUNS = f"""
  WITH n AS ({NOTES}), r AS (
    SELECT *, CAST(count_if(type = 'STARTED') OVER (ORDER BY seq) AS BIGINT) AS run FROM n)
"""


def _runs(spark, sf_dir):
    notes = snapshot.read_notifications(notifications(spark, sf_dir), F.lit(0).cast("bigint"))
    return snapshot.with_run(notes)


@query(
    RUNS
    + """, l AS (SELECT run, max_by(type, seq) AS type, max_by(ts, seq) AS ts, max_by(tab, seq) AS tab,
              min_by(ts, CASE WHEN type NOT IN ('COMPLETED','ABORTED') THEN seq END) AS begun
            FROM r GROUP BY run)
    SELECT run, CASE WHEN type IN ('COMPLETED','ABORTED') THEN type ELSE 'IN_PROGRESS' END AS phase,
           CASE WHEN type = 'IN_PROGRESS' THEN tab END AS current_table, begun AS started_at_ms,
           CASE WHEN type IN ('COMPLETED','ABORTED') THEN ts END AS completed_at_ms FROM l"""
)
def snapshot_runs(spark, sf_dir):
    return snapshot.snapshot_runs(_runs(spark, sf_dir))


@query(
    RUNS
    + """SELECT run, tab AS scanned_table, max_by(n, seq) AS scanned_rows FROM r
         WHERE type = 'TABLE_SCAN_COMPLETED' GROUP BY run, tab"""
)
def snapshot_tables(spark, sf_dir):
    return snapshot.snapshot_tables(_runs(spark, sf_dir))


@query(
    f"""SELECT seq, ts, CASE type WHEN 'TABLE_SCAN_COMPLETED' THEN 'SNAPSHOT_TABLE_COMPLETED'
         ELSE 'SNAPSHOT_' || type END AS event_type,
         CASE WHEN type = 'ABORTED' THEN 'WARN' ELSE 'INFO' END AS severity,
         CASE WHEN type = 'TABLE_SCAN_COMPLETED'
              THEN tab || ' scanned (' || CAST(n AS VARCHAR) || ' rows, SUCCEEDED)' END AS message
       FROM ({NOTES}) WHERE type <> 'IN_PROGRESS'"""
)
def snapshot_timeline(spark, sf_dir):
    notes = snapshot.read_notifications(notifications(spark, sf_dir), F.lit(0).cast("bigint"))
    return snapshot.snapshot_timeline(notes)


# --- schema changes -----------------------------------------------------------------------

_CLASSIFIED = f"""
  SELECT kafka_offset, 1700000000000 + kafka_offset AS event_ts_ms, CAST(kafka_offset * 10 AS VARCHAR) AS scn,
         'CDC' AS schema_name, tab AS table_name, ddl_text,
         CASE WHEN is_snapshot THEN 'SNAPSHOT'
              WHEN ddl_text LIKE '%SUPPLEMENTAL LOG%' OR ddl_text LIKE '  grant %' THEN 'IGNORED'
              ELSE 'DETECTED' END AS state
  FROM ({DDL_TEXT})
"""


def _ddl(spark, sf_dir):
    return ddl.classify_ddl(ddl.parse_ddl(ddl_messages(spark, sf_dir))).drop("is_snapshot")


@query(_CLASSIFIED)
def ddl_classified(spark, sf_dir):
    return _ddl(spark, sf_dir)


@query(f"SELECT kafka_offset, state FROM ({_CLASSIFIED}) WHERE state <> 'SNAPSHOT'")
def ddl_new_events(spark, sf_dir):
    """The stored half comes in again, and every message twice."""
    events = _ddl(spark, sf_dir)
    stored = events.where("state = 'SNAPSHOT'")
    return ddl.new_ddl_events(events.unionByName(events), stored).select("kafka_offset", "state")


_TARGETED = f"""
  WITH d AS ({_CLASSIFIED}), r AS ({REGISTRY})
  SELECT kafka_offset, state, tab, target_schema, ddl_text,
    CASE WHEN target_schema = 'CDC' THEN ddl_text ELSE
      regexp_replace(ddl_text, '(?i)("CDC"\\."' || tab || '"|\\bCDC\\.' || tab || '\\b)',
                     '"TGT"."' || tab || '"', 'g') END AS target_ddl
  FROM (SELECT d.*, d.table_name AS tab, r.target_schema FROM d JOIN r
        ON r.schema_name = d.schema_name AND r.table_name = d.table_name)
"""


@query(f"SELECT kafka_offset, target_ddl FROM ({_TARGETED})")
def ddl_retarget(spark, sf_dir):
    events = _ddl(spark, sf_dir)
    matched = ddl.match_registered(events, registry(spark, sf_dir))
    return ddl.with_target_ddl(matched).select("kafka_offset", "target_ddl")


def _decisions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("kafka_offset"),
        F.when(F.col("p_partkey") % 3 == 0, "REJECT").otherwise("APPROVE").alias("decision"),
    )


@query(
    f"""WITH d AS ({_CLASSIFIED}), t AS ({_TARGETED})
    SELECT d.kafka_offset, CASE WHEN d.state <> 'DETECTED' OR t.tab IS NULL THEN d.state
             WHEN d.kafka_offset % 3 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS new_state,
           CASE WHEN d.state = 'DETECTED' AND d.kafka_offset % 3 > 0 THEN t.target_ddl END AS target_ddl,
           CASE WHEN d.state <> 'DETECTED' THEN 'not waiting for a decision'
                WHEN t.tab IS NULL THEN 'table is not registered' END AS error
    FROM d LEFT JOIN t ON t.kafka_offset = d.kafka_offset"""
)
def ddl_resolved(spark, sf_dir):
    found = ddl.resolve_ddl(
        _ddl(spark, sf_dir), registry(spark, sf_dir), _decisions(spark, sf_dir)
    )
    return found.select("kafka_offset", "new_state", "target_ddl", "error")


@query(
    f"""WITH t AS ({_TARGETED})
    SELECT DISTINCT 'CDC' AS schema_name, tab AS table_name FROM t
    WHERE state = 'DETECTED' AND kafka_offset % 3 = 0"""
)
def paused_tables(spark, sf_dir):
    return ddl.paused_tables(
        ddl.resolve_ddl(_ddl(spark, sf_dir), registry(spark, sf_dir), _decisions(spark, sf_dir))
    )


@query("SELECT CAST(event_id AS VARCHAR) AS scn FROM events WHERE event_type NOT IN ('click', 'error')")
def held_back(spark, sf_dir):
    """Events that still apply while two tables are paused."""
    events = changes(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").where("event_type IN ('click', 'error')")
    paused = kinds.select(F.lit("CDC").alias("schema_name"), F.upper("event_type").alias("table_name"))
    return exclude_paused(events, paused).select(F.col("source.scn").alias("scn"))


def _decided(spark, sf_dir):
    """Two batches of decisions; the second one says the opposite of the first."""
    root = shared_dir(spark, "decisions")
    events, tables = _ddl(spark, sf_dir), registry(spark, sf_dir)
    asked = _decisions(spark, sf_dir)
    opposite = asked.withColumn("decision", F.when(F.col("decision") == "REJECT", "APPROVE").otherwise("REJECT"))
    args = (spark, f"{root}/log", events, tables)
    at = datetime(2026, 1, 1)
    decisions.decide(*args, asked, at, 0, timeline=f"{root}/timeline")
    second = decisions.decide(*args, opposite, at + timedelta(hours=1), 1, timeline=f"{root}/timeline")
    return root, events, second


@query(
    f"""WITH d AS ({_CLASSIFIED}), t AS ({_TARGETED})
    SELECT d.kafka_offset, CASE WHEN d.state <> 'DETECTED' OR t.tab IS NULL THEN d.state
             WHEN d.kafka_offset % 3 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS state,
           CASE WHEN d.state = 'DETECTED' AND t.tab IS NULL THEN 'table is not registered'
                ELSE 'not waiting for a decision' END AS second_error
    FROM d LEFT JOIN t ON t.kafka_offset = d.kafka_offset"""
)
def ddl_decided_once(spark, sf_dir):
    """States after two batches of decisions, and why the second decision was refused."""
    root, events, second = _decided(spark, sf_dir)
    states = decisions.with_decisions(events, decisions.decision_log(spark, f"{root}/log"))
    return states.select("kafka_offset", "state").join(
        second.select("kafka_offset", F.col("error").alias("second_error")), "kafka_offset"
    )


@query(
    f"""WITH t AS ({_TARGETED})
    SELECT kafka_offset AS event_id, TIMESTAMP '2026-01-01' AS event_at, tab AS table_name,
           CASE WHEN kafka_offset % 3 = 0 THEN 'DDL_REJECTED' ELSE 'DDL_APPROVED' END AS event_type,
           CASE WHEN kafka_offset % 3 = 0 THEN 'WARN' ELSE 'INFO' END AS severity
    FROM t WHERE state = 'DETECTED'"""
)
def ddl_timeline(spark, sf_dir):
    """Timeline rows that decisions leave, newest first."""
    root, _, _ = _decided(spark, sf_dir)
    rows = timeline(spark.read.parquet(f"{root}/timeline"), limit=None)
    return rows.select("event_id", "event_at", "table_name", "event_type", "severity")


@query(
    f"""WITH t AS ({_TARGETED})
    SELECT p_partkey FROM part WHERE 'P' || CAST(p_size AS VARCHAR) NOT IN (
      SELECT tab FROM t WHERE state = 'DETECTED' AND kafka_offset % 3 = 0)"""
)
def held_back_by_log(spark, sf_dir):
    """Changes that still apply while the log holds rejected schema changes of some tables."""
    root, _, _ = _decided(spark, sf_dir)
    paused = decisions.paused_by_log(decisions.decision_log(spark, f"{root}/log"))
    name = F.concat(F.lit("P"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.struct(F.lit("CDC").alias("schema"), name.alias("table")).alias("source")
    )
    return exclude_paused(rows, paused).select("p_partkey")


@query(
    """SELECT doc_id, CASE WHEN strpos(t, chr(10)) > 1 THEN substr(t, 1, strpos(t, chr(10)) - 1)
              WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS headline
       FROM (SELECT doc_id, regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS t FROM documents)"""
)
def headlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", first_line("text").alias("headline"))


@query(f"SELECT DISTINCT target_schema FROM ({REGISTRY})")
def target_schema_list(spark, sf_dir):
    return target_schemas(registry(spark, sf_dir))


# --- timeline -----------------------------------------------------------------------------


def _timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.lit("CDC").alias("schema_name"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("table_name"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
    )


@query(
    """SELECT event_id, 'U' || CAST(user_id AS VARCHAR) AS table_name FROM events
       WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100"""
)
def newest_errors(spark, sf_dir):
    return timeline(_timeline(spark, sf_dir), severity="ERROR").select("event_id", "table_name")


@query(
    """SELECT event_id, 'U' || CAST(user_id AS VARCHAR) AS table_name FROM events
       WHERE 'cdc.u' || CAST(user_id AS VARCHAR) LIKE '%c.u1%'"""
)
def timeline_search(spark, sf_dir):
    return timeline(_timeline(spark, sf_dir), text="C.U1", limit=None).select(
        "event_id", "table_name"
    )
