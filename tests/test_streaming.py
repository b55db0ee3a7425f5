import json

import pytest
from pyspark.sql import functions as F, types as T

from fixtures import FOUR, FOUR_STATE, T0, event, events, rows
from test_state import as_events, brute
from test_target import history
from tidemark.functions.connect import connect_value
from tidemark.model import SOURCE_CORE, envelope
from tidemark.operators import snapshot, state
from tidemark.plans import jobs
from tidemark.sinks import changelog as log
from tidemark.sinks.target import TargetTable
from tidemark.sources.envelopes import read_envelopes
from tidemark.streaming import queries as S

VALUE = T.StructType([T.StructField("value", T.StringType())])


def put(df, folder):
    df.select(connect_value(df.schema).alias("value")).coalesce(1).write.mode("append").json(folder)


def stream(spark, folder, row=None, **options):
    row = row or events(spark, []).schema["after"].dataType
    return read_envelopes(S.message_stream(spark, folder, VALUE, **options), row, source=SOURCE_CORE)


def run(start, *args, **kw):
    q = start(*args, interval=None, **kw)
    q.awaitTermination()
    return q


def test_two_sinks_pause_and_catch_up(spark, path):
    changes = history(200)
    topic, where = f"{path}/topic", log.table_path(path, "CDC", "ORDERS")
    target = TargetTable(spark, f"{path}/target", ["ID"])
    put(as_events(spark, changes[:80]), topic)
    run(S.start_apply, stream(spark, topic), target, f"{path}/cp1")
    run(S.start_changelog, stream(spark, topic), where, f"{path}/cp2")
    assert rows(target.read()) == brute(changes[:80])
    # Apply is paused: the changelog goes on, the target stands still.
    put(as_events(spark, changes[80:150]), topic)
    run(S.start_changelog, stream(spark, topic), where, f"{path}/cp2")
    assert log.scan_changelog(spark, where).count() == 150
    assert rows(target.read()) == brute(changes[:80])
    # Resumed, it starts where it stopped.
    put(as_events(spark, changes[150:]), topic)
    q = run(S.start_apply, stream(spark, topic), target, f"{path}/cp1")
    assert sum(p["numInputRows"] for p in q.recentProgress) == 120
    assert rows(target.read()) == brute(changes)
    run(S.start_changelog, stream(spark, topic), where, f"{path}/cp2")
    assert rows(state.current_state(log.scan_changelog(spark, where), ["ID"])) == brute(changes)
    # Past the retention of the topic the changelog brings a target back.
    lost = TargetTable(spark, f"{path}/lost", ["ID"])
    jobs.recover(spark, where, lost, 0)
    assert rows(lost.read()) == brute(changes)


def test_delivered_twice_changes_nothing(spark, path):
    changes = history(120)
    topic = f"{path}/topic"
    target = TargetTable(spark, f"{path}/target", ["ID"])
    put(as_events(spark, changes), topic)
    put(as_events(spark, changes[40:90]), topic)
    run(S.start_apply, stream(spark, topic, maxFilesPerTrigger="1"), target, f"{path}/cp1", compact_every=1)
    assert rows(target.read()) == brute(changes)
    # A lost checkpoint reads everything again.
    run(S.start_apply, stream(spark, topic), target, f"{path}/cp-new", prefix="reread")
    assert rows(target.read()) == brute(changes)


def test_rejected_columns_stop_one_table_only(spark, path):
    topic = f"{path}/topic"
    target = TargetTable(spark, f"{path}/target", ["ID"])
    put(events(spark, FOUR), topic)
    run(S.start_apply, stream(spark, topic), target, f"{path}/cp")
    wide = T.StructType([*events(spark, []).schema["after"].dataType.fields, T.StructField("EXTRA", T.IntegerType())])
    put(events(spark, [event("c", 2000, after=(3, "", "", 7))], wide), topic)
    with pytest.raises(Exception, match="EXTRA"):
        run(S.start_apply, stream(spark, topic, wide), target, f"{path}/cp")
    assert rows(target.read()) == FOUR_STATE
    # With the old columns the retry takes the same messages.
    run(S.start_apply, stream(spark, topic), target, f"{path}/cp")
    assert rows(target.read()) == [*FOUR_STATE, (3, "", "")]


def test_paused_tables_are_held_back(spark, path):
    topic = f"{path}/topic"
    put(events(spark, [event("c", 1, after=(1, "", "")), event("c", 2, after=(2, "", ""), table="T2")]), topic)
    target = TargetTable(spark, f"{path}/target", ["ID"])
    paused = spark.createDataFrame([("CDC", "T2")], "schema_name string, table_name string")
    run(S.start_apply, stream(spark, topic), target, f"{path}/cp", paused=paused)
    assert rows(target.read()) == [(1, "", "")]


def write_json(spark, folder, *docs):
    spark.createDataFrame(list(docs), "kafka_offset bigint, value string").coalesce(1).write.mode("append").json(folder)


def test_ddl_is_stored_once(spark, path):
    from test_control import message

    shape = T.StructType([T.StructField("kafka_offset", T.LongType()), T.StructField("value", T.StringType())])
    for docs in [(message(1, "A"), message(1, "A"), (2, "bad")), (message(1, "A"), message(3, "GRANT x"))]:
        write_json(spark, f"{path}/topic", *docs)
        run(S.start_ddl, S.message_stream(spark, f"{path}/topic", shape), f"{path}/ddl", f"{path}/cp")
    assert rows(S.ddl_events(spark, f"{path}/ddl").select("kafka_offset", "state")) == [(1, "DETECTED"), (3, "IGNORED")]


def test_health_across_batches(spark, path):
    def push(*data):
        shape = "observed_at timestamp_ntz, name string, state string, trace string"
        df = spark.sql("select * from values " + ",".join(f"(timestamp_ntz'2024-01-01 00:00:{t:02d}', '{n}', '{s}', null)" for t, n, s in data) + " as t(observed_at, name, state, trace)")
        df.selectExpr("observed_at", "name", "state", "cast(trace as string) trace").coalesce(1).write.mode("append").parquet(f"{path}/in")
        df = spark.readStream.schema(S.STATE_ROW).parquet(f"{path}/in")
        run(S.start_health, df, f"{path}/health", f"{path}/cp")
        assert shape

    push((1, "a", "RUNNING"), (1, "b", "FAILED"), (2, "b", "FAILED"))
    push((3, "a", "FAILED"), (3, "c", "PAUSED"))
    push((4, "b", "UNKNOWN"))
    push((5, "a", "RUNNING"), (6, "a", "FAILED"), (6, "b", "RUNNING"))
    got = S.health_log(spark, f"{path}/health").select(F.date_format("observed_at", "s").cast("int"), "name", "event_type", "prev_state")
    assert rows(got.fillna("-")) == [
        (1, "b", "CONNECTOR_FAILED", "-"), (3, "a", "CONNECTOR_FAILED", "RUNNING"), (5, "a", "CONNECTOR_RECOVERED", "FAILED"),
        (6, "a", "CONNECTOR_FAILED", "RUNNING"), (6, "b", "CONNECTOR_RECOVERED", "UNKNOWN"),
    ]


def test_snapshot_progress_across_batches(spark, path):
    from test_control import note

    shape = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])

    def push(*docs):
        spark.createDataFrame(list(docs), shape).coalesce(1).write.mode("append").json(f"{path}/in")
        messages = S.message_stream(spark, f"{path}/in", shape)
        run(S.start_snapshot_progress, snapshot.read_notifications(messages, F.lit(0).cast("bigint")), f"{path}/out", f"{path}/cp")
        r = S.snapshot_progress(spark, f"{path}/out").first()
        return r["phase"], r["current_table"], r["started_at_ms"], r["completed_at_ms"], r["tables"]

    assert push(note(0, "STARTED", 10)) == ("IN_PROGRESS", None, 10, None, None)
    scan = {"scanned_collection": "T1", "total_rows_scanned": "5"}
    assert push(note(1, "IN_PROGRESS", 11, current_collection_in_progress="T1")) == ("IN_PROGRESS", "T1", 10, None, None)
    assert push(note(2, "TABLE_SCAN_COMPLETED", 12, **scan), note(3, "IN_PROGRESS", 13, current_collection_in_progress="T2")) == ("IN_PROGRESS", "T2", 10, None, {"T1": 5})
    assert push(note(4, "TABLE_SCAN_COMPLETED", 14, scanned_collection="T2", total_rows_scanned=6), note(5, "COMPLETED", 15)) == ("COMPLETED", None, 10, 15, {"T1": 5, "T2": 6})
    assert push(note(6, "STARTED", 20), note(7, "TABLE_SCAN_COMPLETED", 21, **scan)) == ("IN_PROGRESS", None, 20, None, {"T1": 5})


def test_closed_hours_only_and_late_samples_dropped(spark, path):
    def push(*data):
        values = ",".join(f"(timestamp_ntz'2024-01-01 {t}', 'PUBLISH', 'T1', {v}L)" for t, v in data)
        spark.sql(f"select * from values {values} as t(sampled_at, metric, metric_name, sample_value)").coalesce(1).write.mode("append").parquet(f"{path}/in")
        shape = "sampled_at timestamp_ntz, metric string, metric_name string, sample_value bigint"
        out = S.rollup_stream(spark.readStream.schema(shape).parquet(f"{path}/in")).writeStream.format("parquet")
        q = out.option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.schema(shape).parquet(f"{path}/out").select(F.hour("sampled_at"), "sample_value")
        return rows(got)

    assert push(("10:01:00", 1), ("10:59:00", 2), ("11:02:00", 4)) == []
    assert push(("11:06:00", 5)) == [(10, 3)]
    assert push(("10:30:00", 100), ("12:10:00", 7)) == [(10, 3), (11, 9)]
