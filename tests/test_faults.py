"""Cases that once gave wrong results: ties, null keys, narrow batches, bad messages, late polls, broken swaps."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import ROW, T0, event, events, rows
from tidemark.functions.text import cause_line
from tidemark.operators import ddl, routing, state
from tidemark.plans import jobs
from tidemark.sinks import changelog as log
from tidemark.sinks import files, stores
from tidemark.sinks.target import SchemaMismatch, TargetTable
from tidemark.sources.envelopes import read_envelopes, rejected
from tidemark.streaming.queries import _watch, health_log


def test_rows_changed_twice_in_a_transaction_keep_the_last(spark, path):
    data = [event("c", 5, after=(k, "old", "a"), tx="t") for k in range(20)]
    data += [event("u", 5, after=(k, "new", "b"), tx="t") for k in range(20)]
    df = events(spark, data).coalesce(1)
    log.append_changelog(df, f"{path}/log", "one")
    log.append_changelog(events(spark, [event("u", 5, after=(0, "newest", "c"), tx="t")]), f"{path}/log", "two")
    target = TargetTable(spark, f"{path}/t", ["ID"])
    jobs.recover(spark, f"{path}/log", target, 0)
    want = [(k, "newest" if k == 0 else "new", "c" if k == 0 else "b") for k in range(20)]
    assert rows(target.read()) == want
    shuffled = events(spark, data).withColumn("n", F.monotonically_increasing_id()).orderBy(F.rand(1))
    assert rows(state.current_state(shuffled, ["ID"], seq="n"))[1:] == want[1:]


def test_null_keys_merge_alike_in_both_plans(spark):
    old = state.fold(state.change_rows(events(spark, [event("c", 1, after=(1, "a", "x")), event("c", 1, after=(None, "b", "x"))])), ["ID"])
    new = state.change_rows(events(spark, [event("u", 2, after=(None, "c", "x"))]))
    for small in (True, False):
        got = state.live(state.merge_batch(old, new, ["ID"], small)).collect()
        assert sorted((x.ID or -1, x.AMOUNT) for x in got) == [(-1, "c"), (1, "a")]


def test_narrow_batches_keep_what_they_lack(spark, path):
    target = TargetTable(spark, path, ["ID"])
    full = [event("c", 1, after=(k, f"a{k}", "x")) for k in (1, 2, 3)]
    target.apply(state.change_rows(events(spark, full)), "b1")
    more = [
        event("u", 2, after=(1, None, "y")), event("d", 2, before=(2, None, "x")), event("c", 3, after=(2, None, "z")),
        event("c", 4, after=(4, None, "n")),
    ]
    narrow = state.change_rows(events(spark, more)).drop("AMOUNT")
    for _ in range(2):
        target.apply(narrow, "b2")
    got = sorted((x.ID, x.AMOUNT, x.STATUS) for x in target.read().collect())
    assert got == [(1, "a1", "y"), (2, None, "z"), (3, "a3", "x"), (4, None, "n")]
    with pytest.raises(SchemaMismatch):
        target.apply(narrow.drop("ID"), "b3")


def test_bad_messages_are_told_apart(spark):
    good = '{"op":"c","after":{"ID":1,"AMOUNT":"2","STATUS":"s"},"source":{"scn":"1"},"ts_ms":5}'
    texts = [good, '{"payload":' + good + "}", "{", good.replace('"ID":1', '"ID":"x"'), good.replace('"op":"c",', ""), None]
    messages = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "n int, value string")
    taken = read_envelopes(messages, ROW, on_error="drop")
    assert sorted((x.n, x.after.ID) for x in taken.collect()) == [(0, 1), (1, 1)]
    got = sorted((x.n, x.value, x.reason) for x in rejected(messages, ROW).collect())
    assert got == [(2, texts[2], "malformed"), (3, texts[3], "malformed"), (4, texts[4], "no operation")]
    for bad in (2, 3, 4):
        with pytest.raises(Exception, match="bad message"):
            read_envelopes(messages.where(F.col("n") == bad), ROW).collect()


def test_long_causes_are_whole(spark):
    text = "x" * 1_000_500
    df = spark.createDataFrame([("first\nCaused by: " + text,)], "t string")
    assert df.select(F.length(cause_line("t"))).first()[0] == 1_000_500


def test_routing_needs_the_schema(spark, path):
    registry = spark.createDataFrame([("A", "T"), ("B", "T")], "schema_name string, table_name string")
    df = events(spark, [event("c", k, after=(k, "", ""), table="T") for k in range(3)])
    df = df.withColumn("source", F.col("source").withField("schema", F.get(F.array(F.lit("A"), F.lit("B"), F.lit("X")), F.col("after.ID").cast("int"))))
    got = routing.route(df, registry).select("after.ID", "changelog_table")
    assert rows(got) == [(0, "changelog.a_t"), (1, "changelog.b_t")]


def test_blank_statements_and_names_that_differ_in_case(spark):
    texts = ['{"ddl":"\\n\\t "}', '{"ddl":" ALTER TABLE T ADD X INT ","tableChanges":[{"id":"s.t"}]}']
    parsed = ddl.parse_ddl(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "kafka_offset long, value string"))
    assert [x.kafka_offset for x in parsed.collect()] == [1]
    registry = spark.createDataFrame(
        [("s", "t", "low", "t"), ("S", "T", "UP", "T")],
        "schema_name string, table_name string, target_schema string, target_table string")
    got = ddl.match_registered(parsed, registry).select("reg_schema", "target_schema").collect()
    assert [tuple(x) for x in got] == [("S", "UP")]


def test_overtaken_polls_tell_nothing(spark, path):
    def poll(minute, state):
        return (datetime(2025, 1, 1, 10, minute), "c1", state, None)

    schema = "observed_at timestamp_ntz, name string, state string, trace string"
    for n, polls in enumerate([[poll(5, "FAILED")], [poll(3, "FAILED"), poll(5, "RUNNING")], [poll(6, "RUNNING")], [poll(4, "FAILED")]]):
        _watch(path, spark.createDataFrame(polls, schema), n)
    got = [(x.observed_at.minute, x.event_type) for x in health_log(spark, path).orderBy("observed_at").collect()]
    assert got == [(5, "CONNECTOR_FAILED"), (6, "CONNECTOR_RECOVERED")]


def test_a_broken_off_purge_loses_nothing(spark, path, monkeypatch):
    now = datetime(2025, 3, 10, 12, 0)
    data = [(now - timedelta(hours=h), "PUBLISH", "T1", 1, None, "MIN") for h in range(72)]
    schema = "sampled_at timestamp_ntz, metric string, metric_name string, sample_value long, sample_value2 long, resolution string"
    stores.append_samples(spark.createDataFrame(data, schema), path)

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(files, "rename", stop)
        with pytest.raises(RuntimeError):
            stores.purge_store(spark, path, now)
    for _ in range(2):
        stores.purge_store(spark, path, now)
        assert stores.read_samples(spark, path).count() == 49
    assert not files.exists(spark, f"{path}/_staged")
    since = F.lit(str(now - timedelta(hours=5))).cast("timestamp_ntz")
    recent = stores.read_samples(spark, path, since)
    assert recent.count() == 6
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "p_day" in plan.split("PartitionFilters:")[1].split("]")[0]
