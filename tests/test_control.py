import json

import pytest
from pyspark.sql import functions as F

from fixtures import event, events, rows
from tidemark.model import CONNECTOR_STATUS
from tidemark.operators import ddl, health, snapshot
from tidemark.operators.routing import attribute, exclude_paused

# --- schema changes --------------------------------------------------------------------


def message(offset, text, tab='"CDC"."AUTO_100"', snap="false", wrap=True, **extra):
    body = {"source": {"snapshot": snap, "scn": "31066"}, "ts_ms": 1700, "ddl": text, **extra}
    if tab is not None:
        body["tableChanges"] = [{"type": "ALTER", "id": tab}, {"type": "X", "id": "S.OTHER"}]
    return (offset, json.dumps({"schema": {}, "payload": body} if wrap else body))


def parse(spark, *messages):
    df = spark.createDataFrame(list(messages), "kafka_offset bigint, value string")
    return ddl.classify_ddl(ddl.parse_ddl(df))


def test_parse(spark):
    got = parse(
        spark,
        message(1, "ALTER TABLE X"),
        message(2, "ALTER TABLE X", tab="DB.CDC.T", wrap=False, snap="LAST"),
        message(3, "GRANT a", tab=None, snap="FALSE"),
        message(4, "ALTER TABLE X", tab="NODOT"),
        message(5, "  "),
        message(6, None),
        (7, "not json"),
        (8, None),
        message(9, "ALTER", snap="true"),
    )
    cols = ["kafka_offset", "event_ts_ms", "scn", "schema_name", "table_name", "is_snapshot", "state"]
    assert [tuple(r) for r in got.select(cols).orderBy("kafka_offset").collect()] == [
        (1, 1700, "31066", "CDC", "AUTO_100", False, "DETECTED"),
        (2, 1700, "31066", "DB", "CDC.T", True, "SNAPSHOT"),
        (3, 1700, "31066", None, None, False, "IGNORED"),
        (4, 1700, "31066", None, None, False, "DETECTED"),
        (9, 1700, "31066", "CDC", "AUTO_100", True, "SNAPSHOT"),
    ]


def test_missing_snapshot_flag_is_false(spark):
    df = spark.createDataFrame([(1, '{"ddl": "DROP TABLE X"}')], "kafka_offset bigint, value string")
    row = ddl.classify_ddl(ddl.parse_ddl(df)).first()
    assert (row["state"], row["event_ts_ms"], row["scn"]) == ("DETECTED", 0, None)


def test_offset_is_stored_once(spark):
    parsed = parse(spark, message(1, "A"), message(1, "A"), message(2, "B"))
    fresh = ddl.new_ddl_events(parsed, parsed.where("kafka_offset = 2"))
    assert rows(fresh.select("kafka_offset")) == [(1,)]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        [("CDC", "AUTO_100", "TGT_OWN", "AUTO_100_COPY"), ("CDC", "T1", None, None)],
        "schema_name string, table_name string, target_schema string, target_table string",
    )


def test_decisions(spark, registry):
    found = parse(
        spark,
        message(1, "ALTER TABLE CDC.AUTO_100 ADD (X NUMBER)", tab="cdc.auto_100"),
        message(2, "ALTER TABLE CDC.T1 ADD (X NUMBER)", tab="CDC.T1"),
        message(3, "ALTER TABLE CDC.T1 DROP (X)", tab="CDC.T1"),
        message(4, "GRANT x", tab="CDC.T1"),
        message(5, "ALTER TABLE S.T", tab="S.T"),
    )
    decisions = spark.createDataFrame([(1, "APPROVE"), (2, "APPROVE"), (3, "REJECT"), (4, "APPROVE"), (5, "REJECT"), (6, "APPROVE")], "kafka_offset bigint, decision string")
    resolved = ddl.resolve_ddl(found, registry, decisions)
    got = {r["kafka_offset"]: r for r in resolved.collect()}
    assert got[1]["target_ddl"] == 'ALTER TABLE "TGT_OWN"."AUTO_100_COPY" ADD (X NUMBER)'
    assert got[1]["note"] == "applied as TGT_OWN.AUTO_100_COPY"
    assert (got[2]["target_ddl"], got[2]["note"]) == ("ALTER TABLE CDC.T1 ADD (X NUMBER)", "applied to target")
    assert {n: r["new_state"] for n, r in got.items()} == {1: "APPROVED", 2: "APPROVED", 3: "REJECTED", 4: "IGNORED", 5: "DETECTED", 6: None}
    assert {n: r["error"] for n, r in got.items()} == {
        1: None, 2: None, 3: None, 4: "not waiting for a decision", 5: "table is not registered", 6: "no such event",
    }
    paused = ddl.paused_tables(resolved)
    assert rows(paused) == [("CDC", "T1")]
    data = [event("c", 1, after=(1, "", ""), table="T1"), event("c", 2, after=(1, "", ""), table="AUTO_100")]
    assert rows(exclude_paused(events(spark, data), paused).select("source.scn")) == [("2",)]


def test_history(spark):
    df = parse(spark, message(1, "A"), message(3, "GRANT x"), message(2, "B"))
    assert [r["kafka_offset"] for r in ddl.ddl_history(df).collect()] == [3, 2, 1]
    assert [r["kafka_offset"] for r in ddl.ddl_history(df, "DETECTED").collect()] == [2, 1]


# --- health ----------------------------------------------------------------------------


def status(state, *tasks, trace=None):
    return ((state, trace), [(i, s, t) for i, (s, t) in enumerate(tasks)])


def observed(spark, *steps):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("at", T.LongType()), T.StructField("name", T.StringType()), T.StructField("status", CONNECTOR_STATUS)])
    return health.with_state(spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], shape))


def transitions(df):
    found = health.health_events(df, "name", ["at"], F.col("at"), 10)
    return [(r["at"], r["event_type"], r["prev_state"]) for r in found.orderBy("at").collect()]


OK = ("RUNNING", None)


def test_effective_state_and_trace(spark):
    df = observed(
        spark,
        ("a", status("RUNNING", OK, ("FAILED", "boom"))),
        ("a", status("PAUSED", ("PAUSED", None), trace="own")),
        ("a", ((None, None), [])),
        ("a", (None, None)),
        ("a", status("RUNNING", ("RUNNING", "t1"), ("FAILED", "t2"), trace="own")),
    )
    assert [(r["state"], r["trace"]) for r in df.orderBy("at").collect()] == [
        ("FAILED", "boom"), ("PAUSED", "own"), ("UNKNOWN", None), ("UNKNOWN", None), ("FAILED", "t1"),
    ]


@pytest.mark.parametrize(
    "states,want",
    [
        (["RUNNING", "FAILED"], [(1, "CONNECTOR_FAILED", "RUNNING")]),
        (["FAILED"], [(0, "CONNECTOR_FAILED", None)]),
        (["RUNNING"], []),
        (["FAILED", "FAILED"], [(0, "CONNECTOR_FAILED", None)]),
        (["FAILED", "UNKNOWN", "PAUSED", "RUNNING"], [(0, "CONNECTOR_FAILED", None), (2, "CONNECTOR_RECOVERED", "UNKNOWN")]),
        (["RUNNING", "PAUSED", "RUNNING"], []),
    ],
)
def test_transitions(spark, states, want):
    assert transitions(observed(spark, *[("a", status(s)) for s in states])) == want


def test_read_status(spark):
    doc = {"a": {"status": {"connector": {"state": "RUNNING", "worker_id": "x"}, "tasks": [{"id": 0, "state": "FAILED", "trace": "t"}]}}, "b": {"status": {}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert rows(health.with_state(health.read_status(df)).select("name", "state")) == [("a", "FAILED"), ("b", "UNKNOWN")]


def test_attribution(spark):
    shape = "schema_name string, table_name string"
    tables = spark.createDataFrame([("CDC", "T1"), ("B", "CDC_T1"), ("CDC", "T2")], shape)
    names = spark.createDataFrame([("sink-cdc_t1",), ("sink-b_cdc_t1",), ("x-cdc_t2",), ("dz-source",), ("cdc_t2",)], "name string")
    got = {r["name"]: (r["schema_name"], r["table_name"]) for r in attribute(names, tables).collect()}
    # The first by schema and table wins, even when a longer ending matches too.
    assert got == {
        "sink-cdc_t1": ("CDC", "T1"), "sink-b_cdc_t1": ("B", "CDC_T1"), "x-cdc_t2": ("CDC", "T2"),
        "cdc_t2": ("CDC", "T2"), "dz-source": ("-", "dz-source"),
    }
    only = attribute(names, tables.where("table_name = 'T2'")).where("name = 'dz-source'").first()
    assert (only["schema_name"], only["table_name"]) == ("CDC", "T2")
    none = attribute(names, tables.where("false")).where("name = 'dz-source'").first()
    assert (none["schema_name"], none["table_name"]) == ("-", "dz-source")


def test_attribution_has_no_cross_join(spark):
    names = spark.createDataFrame([("sink-cdc_t1",)], "name string")
    tables = spark.createDataFrame([("CDC", "T1")], "schema_name string, table_name string")
    plan = attribute(names, tables)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_attribution_broadcasts_no_endings(spark):
    names = spark.createDataFrame([("sink-cdc_t1",), ("x",), (None,), ("x",)], "name string")
    tables = spark.createDataFrame([("CDC", "T1"), ("CDC", "T2")], "schema_name string, table_name string")
    got = attribute(names, tables)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    assert {tuple(r) for r in got.collect()} == {("sink-cdc_t1", "CDC", "T1"), ("x", "-", "x"), (None, "-", None)}
    assert got.count() == 3


@pytest.mark.parametrize(
    "states,want",
    [([], ("none", 0)), (["RUNNING"], ("ok", 1)), (["RUNNING", "PAUSED"], ("warn", 2)), (["PAUSED", "FAILED"], ("crit", 2)), (["UNKNOWN"], ("crit", 1))],
)
def test_sink_group(spark, states, want):
    data = [(f"dz-jdbc-sink-{i}", s) for i, s in enumerate(states)] + [("dz-source", "FAILED")]
    assert tuple(health.sink_group(spark.createDataFrame(data, "name string, state string")).first()) == want


def test_health_timeline(spark):
    df = observed(spark, ("x-cdc_t1", status("RUNNING")), ("x-cdc_t1", status("FAILED", trace="boom")), ("x-cdc_t1", status("RUNNING")), ("other", status("FAILED")))
    found = health.health_events(df.withColumn("observed_at", F.col("at")), "name", ["at"], F.col("at"), 10)
    tables = spark.createDataFrame([("CDC", "T1"), ("CDC", "T2")], "schema_name string, table_name string")
    got = health.health_timeline(found, tables).orderBy("observed_at").drop("observed_at")
    assert [tuple(r) for r in got.collect()] == [
        ("CDC", "T1", "CONNECTOR_FAILED", "ERROR", "x-cdc_t1 RUNNING → FAILED", "boom"),
        ("CDC", "T1", "CONNECTOR_RECOVERED", "INFO", "x-cdc_t1 FAILED → RUNNING", None),
        ("-", "other", "CONNECTOR_FAILED", "ERROR", "other first seen as FAILED", None),
    ]


# --- snapshot progress --------------------------------------------------------------------


def note(seq, kind, ts=None, wrap=False, family="Initial Snapshot", **data):
    body = {"id": "x", "aggregate_type": family, "type": kind, "additional_data": data}
    if ts is not None:
        body["timestamp"] = ts
    return (seq, json.dumps({"schema": {}, "payload": body} if wrap else body))


def runs(spark, *messages, width=2):
    df = spark.createDataFrame(list(messages), "seq bigint, value string")
    return snapshot.with_run(snapshot.read_notifications(df, F.lit(77).cast("bigint")), width=width)


def test_snapshot_fold(spark):
    r = runs(
        spark,
        note(0, "IN_PROGRESS", "5", current_collection_in_progress="A"),
        note(1, "STARTED", 10),
        note(2, "IN_PROGRESS", 11, wrap=True, current_collection_in_progress="CDC.T1"),
        note(3, "TABLE_SCAN_COMPLETED", 12, scanned_collection="CDC.T1", total_rows_scanned="96949", status="SUCCEEDED"),
        note(4, "STARTED", 12, family="Incremental Snapshot"),
        (5, "bad json"),
        note(6, "TABLE_SCAN_COMPLETED", 13, scanned_collection="CDC.T2", total_rows_scanned=7),
        note(7, "TABLE_SCAN_COMPLETED", 14, scanned_collection="CDC.T1", total_rows_scanned=8),
        note(8, "SOMETHING", 15),
        note(9, "COMPLETED", 16),
    )
    assert rows(snapshot.snapshot_runs(r)) == [(0, "IN_PROGRESS", "A", 5, None), (1, "COMPLETED", None, 10, 16)]
    last = snapshot.snapshot_status(r).first()
    assert (last["phase"], last["tables"]) == ("COMPLETED", {"CDC.T1": 8, "CDC.T2": 7})


def test_snapshot_edges(spark):
    assert rows(snapshot.snapshot_runs(runs(spark, note(0, "ABORTED")))) == [(0, "ABORTED", None, None, 77)]
    r = runs(spark, note(0, "COMPLETED", 3), note(1, "IN_PROGRESS", 4, current_collection_in_progress="A"), note(2, "STARTED", 5), note(3, "TABLE_SCAN_COMPLETED", 6))
    assert rows(snapshot.snapshot_runs(r)) == [(0, "IN_PROGRESS", "A", 4, None), (1, "IN_PROGRESS", None, 5, None)]
    assert rows(snapshot.snapshot_tables(r)) == [(1, "?", 0)]


def test_snapshot_timeline(spark):
    df = spark.createDataFrame(
        [note(0, "STARTED", 1), note(1, "IN_PROGRESS", 2), note(2, "TABLE_SCAN_COMPLETED", 3, scanned_collection="T", total_rows_scanned=4, status="OK"), note(3, "ABORTED", 5)],
        "seq bigint, value string",
    )
    got = snapshot.snapshot_timeline(snapshot.read_notifications(df, F.lit(0).cast("bigint"))).orderBy("seq")
    assert [tuple(r)[2:] for r in got.collect()] == [
        ("SNAPSHOT_STARTED", "INFO", None), ("SNAPSHOT_TABLE_COMPLETED", "INFO", "T scanned (4 rows, OK)"), ("SNAPSHOT_ABORTED", "WARN", None),
    ]
