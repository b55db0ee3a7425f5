"""What expires, and what must not."""

import os

from fixtures import event, events, rows
from tidemark.operators import state
from tidemark.sinks import files, positions
from tidemark.sinks.stores import batches, merge_batches, prune_batches, read_batches, write_batch
from tidemark.sinks.target import TargetTable
from tidemark.streaming.queries import expire


def test_positions(spark, path):
    assert positions.low_water(spark, path) is None
    for scn in (5, 7, 9):
        positions.save_position(spark, path, "a", scn)
    positions.save_position(spark, path, "b", 6)
    assert positions.positions(spark, path) == {"a": 9, "b": 6} and positions.low_water(spark, path) == 6
    assert len(os.listdir(f"{path}/consumer=a")) <= 4
    assert positions.reset_position(spark, path, "b") and positions.low_water(spark, path) == 9
    assert not positions.reset_position(spark, path, "b")


def change(spark, op, scn, key):
    image = (key, f"v{scn}", "x")
    return state.change_rows(events(spark, [event(op, scn, before=image if op == "d" else None, after=None if op == "d" else image)]))


def test_tombstones_go_only_below_the_slowest_consumer(spark, path):
    target = TargetTable(spark, f"{path}/t", ["ID"])
    for n, (op, scn, key) in enumerate([("c", 1, 1), ("c", 2, 2), ("d", 10, 1), ("d", 20, 2), ("c", 21, 3)]):
        target.apply(change(spark, op, scn, key), f"b{n}")
    assert expire(target, f"{path}/none") is None
    positions.save_position(spark, f"{path}/c", "fast", 30)
    positions.save_position(spark, f"{path}/c", "slow", 15)
    assert expire(target, f"{path}/c") == 15
    assert rows(target.state().select("ID", "_deleted")) == [(2, True), (3, False)]
    # The slow consumer brings an older image of a row deleted later: it stays deleted.
    target.apply(change(spark, "u", 16, 2), "late")
    assert rows(target.read()) == [(3, "v21", "x")]
    positions.save_position(spark, f"{path}/c", "slow", 30)
    expire(target, f"{path}/c")
    assert rows(target.state().select("ID", "_deleted")) == [(3, False)]


def test_vacuum_keeps_what_an_older_reader_uses(spark, path):
    target = TargetTable(spark, path, ["ID"])
    target.apply(change(spark, "c", 1, 1), "b1")
    target.compact()
    target.apply(change(spark, "c", 2, 2), "b2")
    seen, reader = target.version(), target.read()
    target.apply(change(spark, "c", 3, 3), "b3")
    target.compact()
    target.vacuum(oldest=seen)
    assert rows(reader) == [(1, "v1", "x"), (2, "v2", "x")] and target.read().count() == 3
    target.vacuum()
    assert target.read().count() == 3 and sorted(os.listdir(f"{path}/gen-0")) == ["base-1", "delta"]
    assert len(files.numbered(spark, f"{path}/_pointer")) == 1


def test_folders_stay_few_over_many_batches(spark, path):
    for n in range(50):
        write_batch(spark.createDataFrame([(n,)], "v int"), f"{path}/log", n)
        merge_batches(spark, f"{path}/log", spark.createDataFrame([], "v int").schema, n - 1)
        write_batch(spark.createDataFrame([(n,)], "v int"), f"{path}/last", n)
        prune_batches(spark, f"{path}/last", n)
        assert len(batches(spark, f"{path}/log")) <= 18 and len(batches(spark, f"{path}/last")) <= 2
    schema = spark.createDataFrame([], "v int").schema
    assert rows(read_batches(spark, f"{path}/log", schema)) == [(n,) for n in range(50)]
    assert rows(read_batches(spark, f"{path}/last", schema, before=49)) == [(48,)]


def test_merge_that_was_broken_off(spark, path):
    schema = spark.createDataFrame([], "v int").schema
    for n in range(4):
        write_batch(spark.createDataFrame([(n,)], "v int"), path, n)
    # A half-written merge counts for nothing, a complete one for all its batches.
    os.makedirs(f"{path}/merged=2")
    assert read_batches(spark, path, schema).count() == 4
    merge_batches(spark, path, schema, 2, most=1)
    write_batch(spark.createDataFrame([(1,)], "v int"), path, 1)
    assert rows(read_batches(spark, path, schema)) == [(n,) for n in range(4)]
    merge_batches(spark, path, schema, 2, most=9)
    assert sorted(os.listdir(path)) == ["batch=3", "merged=2"]
