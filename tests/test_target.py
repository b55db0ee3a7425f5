import itertools
import random

import pytest
from pyspark.sql import functions as F, types as T

from fixtures import FOUR, FOUR_STATE, T0, event, events, rows
from test_state import as_events, brute
from tidemark.operators import state
from tidemark.operators.reconcile import orphans
from tidemark.plans import jobs
from tidemark.sinks import changelog as log
from tidemark.sinks.target import SchemaMismatch, TargetTable
from tidemark.streaming.queries import _apply


def history(n=300):
    rng = random.Random(11)
    return [(scn, rng.choice("ccuud"), rng.randrange(20), f"v{scn}") for scn in range(n)]


def test_batches_in_any_order_and_twice(spark, path):
    changes = history()
    cuts = [changes[:100], changes[80:220], changes[200:]]
    batches = [state.change_rows(as_events(spark, c)) for c in cuts]
    for n, order in enumerate(itertools.permutations(range(3))):
        target = TargetTable(spark, f"{path}/t{n}", ["ID"])
        for i in order:
            target.apply(batches[i], f"b{i}")
        assert rows(target.read()) == brute(changes)
        target.apply(batches[order[0]], f"b{order[0]}")
        target.compact()
        target.apply(batches[order[1]], "again")
        assert rows(target.read()) == brute(changes)
        target.compact()
        assert rows(target.read()) == brute(changes)


def test_compaction_waits_until_it_is_due(spark, path):
    target = TargetTable(spark, path, ["ID"])
    load = [event("r", 1, after=(i, f"v{i}", "x")) for i in range(20_000)]
    target.apply(state.change_rows(events(spark, load)), "load")
    target.compact(only_if_due=True)
    assert target._pointer()["base"] == 0
    target.apply(state.change_rows(events(spark, [event("u", 2, after=(5, "new", "x"))])), "b1")
    target.compact(only_if_due=True)
    assert target._pointer()["base"] == 0 and len(target._deltas(target._pointer())) == 1
    read = target.read()
    assert rows(read.where("ID in (5, 6)")) == [(5, "new", "x"), (6, "v6", "x")] and read.count() == 20_000
    target.compact()
    assert target._pointer()["base"] == 1 and target.read().count() == 20_000


def test_delete_of_an_absent_key_is_a_no_op(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(events(spark, [event("d", 5, before=(9, "a", "b"))])), "b")
    assert rows(target.read()) == []


def test_half_written_batch_is_not_seen(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(events(spark, FOUR)), "b1")
    import os

    target.apply(state.change_rows(events(spark, [event("c", 9999, after=(7, "", ""))])), "b2")
    os.remove(f"{path}/gen-0/delta/batch=b2/_SUCCESS")
    assert rows(target.read()) == FOUR_STATE


def test_target_schema_is_fixed(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(events(spark, FOUR)), "b1")
    wider = T.StructType([*events(spark, []).schema["after"].dataType.fields, T.StructField("EXTRA", T.IntegerType())])
    with pytest.raises(SchemaMismatch, match="EXTRA"):
        target.apply(state.change_rows(events(spark, [event("c", 2000, after=(3, "", "", 7))], wider)), "b2")
    assert rows(target.read()) == FOUR_STATE


def test_truncate_starts_a_new_history(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(events(spark, FOUR)), "b1")
    target.truncate()
    assert rows(target.read()) == []
    # Older change numbers than before the truncate are taken.
    target.apply(state.change_rows(events(spark, [event("r", 1, after=(1, "n", "n"))])), "b1")
    assert rows(target.read()) == [(1, "n", "n")]


def test_vacuum_keeps_the_rows(spark, path):
    import os

    changes = history()
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(as_events(spark, changes[:50])), "old")
    target.truncate()
    for i in range(3):
        target.apply(state.change_rows(as_events(spark, changes[i * 100 : (i + 1) * 100])), f"b{i}")
        target.compact()
    target.vacuum()
    assert sorted(os.listdir(path)) == ["_pointer", "gen-1"]
    assert sorted(n for n in os.listdir(f"{path}/gen-1")) == ["base-2", "delta"] and os.listdir(f"{path}/gen-1/delta") == []
    assert rows(target.read()) == brute(changes)
    # An old batch that is delivered again does no harm.
    target.apply(state.change_rows(as_events(spark, changes[:100])), "b0")
    assert rows(target.read()) == brute(changes)


def test_deploy_creates_missing_changelogs(spark, path):
    registry = spark.createDataFrame([("CDC", "T2"), ("CDC", "T1")], "schema_name string, table_name string")
    log.ensure_changelog(spark, path, "CDC", "T1")
    got = [(r["status"], r["detail"]) for r in jobs.deploy(spark, registry, path).collect()]
    assert got == [("KEPT", "cdc_t1"), ("CREATED", "cdc_t2")]
    assert log.list_changelogs(spark, path) == ["cdc_t1", "cdc_t2"]


# --- recovery ------------------------------------------------------------------------


def stored(spark, path, changes):
    where = log.table_path(path, "CDC", "ORDERS")
    log.append_changelog(as_events(spark, changes), where, "c")
    return where


def test_recovery_rehearsal(spark, path):
    changes = history()
    where = stored(spark, path, changes)
    source = spark.createDataFrame(brute(changes), "ID bigint, AMOUNT string, STATUS string")
    target = TargetTable(spark, f"{path}/target", ["ID"])
    target.apply(state.change_rows(as_events(spark, changes)), "live")
    # Damage: rows lost and rows altered, later than anything in the stream.
    lost = [("d", key) for key, _, _ in brute(changes)[:5]]
    damage = [event(op, 10**6, before=(key, "", "")) for op, key in lost]
    target.apply(state.change_rows(events(spark, damage)), "damage")
    assert not jobs.verify(source, target, ["ID", "AMOUNT", "STATUS"]).first()["matched"]
    target.truncate()
    steps = jobs.recover(spark, where, target, 0, go_live=True).collect()
    assert [s["status"] for s in steps] == ["DONE", "APPLIED", "LIVE"]
    assert steps[0]["detail"] == "published=300 skipped=0"
    assert jobs.verify(source, target, ["ID", "AMOUNT", "STATUS"]).first()["matched"]


def test_partial_replay_rebuilds_only_changed_keys(spark, path):
    changes = history()
    where = stored(spark, path, changes)
    target = TargetTable(spark, f"{path}/target", ["ID"])
    jobs.recover(spark, where, target, 250)
    assert rows(target.read()) == brute(changes[250:])


def test_replay_overlap_never_rewinds(spark, path):
    changes = history()
    where = stored(spark, path, changes[:200])
    target = TargetTable(spark, f"{path}/target", ["ID"])
    target.apply(state.change_rows(as_events(spark, changes)), "live")
    jobs.recover(spark, where, target, 0)
    assert rows(target.read()) == brute(changes)


def test_failed_recovery_reports_and_raises(spark, path):
    with pytest.raises(FileNotFoundError):
        jobs.recover(spark, f"{path}/none", TargetTable(spark, path, ["ID"]), 0)


def test_live_and_recovery_share_the_apply_step():
    assert "change_rows" in _apply.__code__.co_names and "change_rows" in jobs.recover.__code__.co_names
    assert "apply" in _apply.__code__.co_names and "apply" in jobs.recover.__code__.co_names


# --- re-snapshot ------------------------------------------------------------------------


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(i, f"a{i}", "s") for i in range(10)], "ID bigint, AMOUNT string, STATUS string")


def old_target(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(state.change_rows(events(spark, [event("c", 50, after=(i, "old", "s")) for i in range(5, 15)])), "old")
    return target


def test_resnapshot_without_truncate_leaves_orphans(spark, path, source):
    target = old_target(spark, path)
    steps = jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 100, T0)
    assert [s["step"] for s in steps.collect()] == ["drain", "load", "live"]
    assert rows(orphans(source, target.read(), ["ID"]).select("ID")) == [(i,) for i in range(10, 15)]
    kept = target.read().join(source, ["ID"], "left_semi").select(source.columns)
    assert rows(kept) == rows(source)


def test_resnapshot_with_truncate_matches(spark, path, source):
    target = old_target(spark, path)
    steps = jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 1, T0, truncate=True)
    assert [s["step"] for s in steps.collect()] == ["drain", "truncate", "load", "live"]
    assert jobs.verify(source, target, source.columns).first()["matched"]
    assert orphans(source, target.read(), ["ID"]).count() == 0


def test_resnapshot_gates(spark, path, source):
    target = old_target(spark, path)
    with pytest.raises(ValueError, match="truncate"):
        jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 1, T0, mode="NO_DATA", truncate=True)
    with pytest.raises(ValueError, match="mode"):
        jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 1, T0, mode="SOME")
    before = rows(target.read())
    held = jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 100, T0, truncate=True, remaining_lag=3)
    assert [s["status"] for s in held.collect()] == ["HOLD"]
    jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 100, T0, mode="NO_DATA")
    assert rows(target.read()) == before


def test_unregister_keeps_the_changelog_unless_asked(spark, path):
    where = stored(spark, path, history(10))
    registry = spark.createDataFrame([("CDC", "ORDERS"), ("CDC", "T2")], "schema_name string, table_name string")
    left = jobs.unregister(spark, registry, "CDC", "ORDERS", path)
    assert rows(left) == [("CDC", "T2")] and log.scan_changelog(spark, where).count() == 10
    jobs.unregister(spark, registry, "CDC", "ORDERS", path, drop=True)
    assert log.list_changelogs(spark, path) == []


# --- batches that carry some columns ---------------------------------------------------


def by_columns(changes):
    """Replay one by one: ``carried`` names the columns a change knows."""
    out = {}
    for _, op, key, value, carried in sorted(changes):
        if op == "d":
            out.pop(key, None)
        else:
            old = out.get(key, (None, None))
            out[key] = (value if "AMOUNT" in carried else old[0], f"s{value}" if "STATUS" in carried else old[1])
    return sorted(((k, *v) for k, v in out.items()), key=str)


def column_rows(spark, changes, carried):
    data = []
    for scn, op, key, value, _ in changes:
        image = (key, value, f"s{value}")
        data.append(event(op, scn, before=image if op == "d" else None, after=None if op == "d" else image))
    lacks = {"AMOUNT", "STATUS"} - set(carried)
    return state.change_rows(events(spark, data).repartition(3)).drop(*lacks)


@pytest.mark.parametrize("small", [True, False])
def test_batches_with_different_columns_in_any_order(spark, path, small, monkeypatch):
    from tidemark.sinks import target as module

    monkeypatch.setattr(module, "SMALL_SHARE", 0 if small else 10**9)
    rng = random.Random(5)
    kinds = [("AMOUNT", "STATUS"), ("AMOUNT",), ("STATUS",), ("AMOUNT", "STATUS")]
    changes = [(n, rng.choice("ccuud"), rng.choice([None, *range(8)]), f"v{n}", kinds[n // 40]) for n in range(160)]
    batches = {i: column_rows(spark, changes[i * 40 : i * 40 + 40], kinds[i]) for i in range(4)}
    # The first batch declares the columns, so it carries all.
    orders = [p for p in itertools.permutations(range(4)) if kinds[p[0]] == kinds[0]]
    for n, order in enumerate(orders[:: 1 if small else 4]):
        target = TargetTable(spark, f"{path}/t{n}", ["ID"])
        for step, i in enumerate(order):
            target.apply(batches[i], f"b{i}")
            if step == n % 3:
                target.compact()
        target.apply(batches[order[1]], "again")
        got = sorted(map(tuple, target.read().collect()), key=str)
        assert got == by_columns(changes), order


def test_rows_deleted_and_created_by_narrow_batches(spark, path):
    target = TargetTable(spark, path, ["ID"])
    full = lambda scn, op="u": column_rows(spark, [(scn, op, 1, f"v{scn}", ())], ("AMOUNT", "STATUS"))
    narrow = lambda scn, op="u": column_rows(spark, [(scn, op, 1, f"v{scn}", ())], ("AMOUNT",))
    target.apply(full(50), "a")
    target.apply(narrow(100), "b")
    target.apply(full(80), "c")
    assert rows(target.read()) == [(1, "v100", "sv80")]
    target.apply(narrow(90, "d"), "d")
    assert rows(target.read()) == [(1, "v100", None)]
    target.apply(full(95), "e")
    assert rows(target.read()) == [(1, "v100", "sv95")]
    target.truncate()
    assert target._pointer()["narrow"] == [] and rows(target.read()) == []
