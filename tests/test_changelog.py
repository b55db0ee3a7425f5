import pytest
from pyspark.sql import functions as F, types as T

from fixtures import FOUR, FOUR_STATE, T0, event, events, rows
from tidemark.model import CHANGELOG_SKELETON, DAY_MS
from tidemark.operators import replay, state
from tidemark.sinks import changelog as log, files

DAY0 = T0 - T0 % DAY_MS


def test_names_and_skeleton(spark, path):
    assert log.ensure_changelog(spark, path, "CDC", "TEST_TABLE_01")
    assert not log.ensure_changelog(spark, path, "CDC", "TEST_TABLE_01")
    assert log.list_changelogs(spark, path) == ["cdc_test_table_01"]
    where = log.table_path(path, "CDC", "TEST_TABLE_01")
    assert log.read_schema(spark, where) == CHANGELOG_SKELETON
    empty = log.scan_changelog(spark, where)
    assert empty.count() == 0 and {"op", "ts_ms", "source", "p_ts_ms"} <= set(empty.columns)


def test_append_scan_replay(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    late = event("u", 1040, after=(2, "1.00", "LATE"), ts_ms=T0 + DAY_MS)
    df = events(spark, [*FOUR, late])
    log.append_changelog(df, where, "c1")
    log.append_changelog(df, where, "c2", cluster=False)
    back = log.scan_changelog(spark, where)
    assert back.count() == 10
    assert rows(state.current_state(back, ["ID"])) == [(2, "1.00", "LATE")]
    # Nothing of the envelope is lost.
    first = back.where("commit_id = 'c1'").select(*df.columns)
    assert sorted(map(str, first.collect())) == sorted(map(str, df.collect()))
    days = [tuple(r)[:2] for r in log.changelog_partitions(back).collect()]
    assert days == [("2025-07-23", 8), ("2025-07-24", 2)]
    total = log.changelog_summary(back).first()
    assert (total["records"], total["commits"]) == (10, 2) and total["files"] >= 4 and total["bytes"] > 0


def test_rows_without_a_time_form_a_bucket(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    log.append_changelog(events(spark, [*FOUR, event("c", 5, after=(9, "", ""), ts_ms=None)]), where, "c")
    days = {r[0]: r[1] for r in log.changelog_partitions(log.scan_changelog(spark, where)).collect()}
    assert days == {"2025-07-23": 4, "(unpartitioned)": 1}


def test_pruning_reaches_the_scan(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    log.append_changelog(events(spark, FOUR), where, "c")
    cut = replay.from_scn(log.scan_changelog(spark, where, since_ms=T0), 1010, since_ms=T0)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f">= {DAY0}" in plan
    assert "GreaterThanOrEqual(scn_num,1010)" in plan
    assert cut.count() == 3
    counts = replay.replay_counts(cut, ["ID"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "before:struct<ID:bigint>,after:struct<ID:bigint>" in plan
    assert tuple(counts.first()) == tuple(replay.replay_counts(cut).first()) == (3, 0)


def test_schema_grows_by_addition(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    log.ensure_changelog(spark, path, "CDC", "ORDERS")
    log.append_changelog(events(spark, FOUR), where, "c1")
    wider = T.StructType([*events(spark, []).schema["after"].dataType.fields, T.StructField("EXTRA", T.IntegerType())])
    log.append_changelog(events(spark, [event("c", 2000, after=(3, "", "", 7))], wider), where, "c2")
    got = log.scan_changelog(spark, where).select("source.scn", "after.EXTRA").collect()
    assert {r[0]: r[1] for r in got} == {"1000": None, "1010": None, "1020": None, "1030": None, "2000": 7}
    clash = T.StructType([T.StructField("ID", T.StringType())])
    with pytest.raises(ValueError, match="ID changes type"):
        log.append_changelog(events(spark, [event("c", 1, after=("x",))], clash), where, "c3")


def test_routing_by_table_name(spark, path):
    data = [*FOUR, event("c", 5, after=(1, "", ""), table="ITEMS"), event("c", 6, after=(1, "", ""), table="OTHER")]
    registry = spark.createDataFrame([("CDC", "ORDERS"), ("CDC", "ITEMS")], "schema_name string, table_name string")
    log.append_routed(events(spark, data), registry, path, "c1")
    assert log.list_changelogs(spark, path) == ["cdc_items", "cdc_orders"]
    totals = log.changelog_summary(log.scan_contents(spark, path)).collect()
    assert [(r["changelog_table"], r["records"]) for r in totals] == [("cdc_items", 1), ("cdc_orders", 4)]
    orders = log.scan_changelog(spark, log.table_path(path, "CDC", "ORDERS"))
    assert rows(state.current_state(orders, ["ID"])) == FOUR_STATE


def test_expiry_and_drop(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    data = [event("c", i, after=(i, "", ""), ts_ms=T0 + i * DAY_MS) for i in range(3)]
    log.append_changelog(events(spark, data), where, "c")
    assert log.expire_changelog(spark, where, DAY0 + DAY_MS - 1) == []
    assert log.expire_changelog(spark, where, DAY0 + 2 * DAY_MS) == [DAY0, DAY0 + DAY_MS]
    assert rows(log.scan_changelog(spark, where).select("after.ID")) == [(2,)]
    log.drop_changelog(spark, where)
    assert log.list_changelogs(spark, path) == [] and files.exists(spark, where)
    log.drop_changelog(spark, where, purge=True)
    assert not files.exists(spark, where)


def test_publish_keeps_replay_order(spark, path):
    import json

    data = [event("u", n, after=(n % 5, str(n), "x")) for n in range(300)]
    out = f"{path}/topic"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        replay.publish(events(spark, data).repartition(6), ["ID"], out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = [n for n in files.children(spark, out) if n.startswith("part-")]
    assert len(names) > 1
    seen = []
    for n in names:
        for line in open(f"{out}/{n}"):
            seen.append(int(json.loads(json.loads(line)["value"])["payload"]["source"]["scn"]))
    assert seen == list(range(300))
