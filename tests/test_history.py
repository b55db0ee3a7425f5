"""Earlier states, snapshots in chunks and row differences against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import event, events, rows
from tidemark.operators import history, incremental, state
from tidemark.operators.diff import differing_buckets, row_diff
from tidemark.operators.ordered import carried_forward
from tidemark.plans import jobs
from tidemark.sinks import files
from tidemark.sinks.target import TargetTable


def made(seed, n, hot=0.4):
    """Changes with ties: (scn, op, key, value), in order of arrival."""
    rng = random.Random(seed)
    return [
        (k // 3, rng.choice("ccuud"), 0 if rng.random() < hot else rng.choice([None, *range(1, 15)]), f"v{k}") for k in range(n)
    ]


def change_rows(spark, changes):
    data = [
        (*event(op, scn, before=(key, v, "x") if op == "d" else None, after=None if op == "d" else (key, v, "x"), tx="t"), n)
        for n, (scn, op, key, v) in enumerate(changes)
    ]
    schema = events(spark, []).schema.add("n", "long")
    return state.change_rows(spark.createDataFrame(data, schema).repartition(3), "n")


def brute_at(changes, scn):
    out = {}
    for s, op, key, value in changes:
        if s <= scn:
            out.pop(key, None) if op == "d" else out.__setitem__(key, value)
    return out


def text(found):
    return sorted(map(tuple, found), key=str)


def test_state_at_any_number(spark):
    changes = made(1, 200)
    found = change_rows(spark, changes)
    for scn in (-1, 0, 20, 66, 100):
        want = [(k, v, "x") for k, v in brute_at(changes, scn).items()]
        assert text(history.state_as_of(found, ["ID"], scn).collect()) == text(want)


@pytest.mark.parametrize("hot_rows,width", [(10**9, 10), (5, 1), (5, 7)])
def test_versions_and_as_of_join(spark, hot_rows, width):
    changes = made(2, 240)
    found = change_rows(spark, changes)
    versions = history.row_versions(found, ["ID"], width, hot_rows).collect()
    last = changes[-1][0]
    for scn in range(last + 1):
        seen = [(v.ID, v.AMOUNT) for v in versions if v.valid_from <= scn and (v.valid_to is None or scn < v.valid_to)]
        assert text(seen) == text(brute_at(changes, scn).items())

    rng = random.Random(3)
    facts = [(rng.choice([None, 0, 0, 0, *range(1, 17)]), rng.randint(-2, last + 2), n) for n in range(200)]
    frame = spark.createDataFrame(facts + facts[:5], "ID long, at long, n int").repartition(4)
    got = history.as_of_join(frame, found, ["ID"], "at", width, hot_rows)
    assert got.columns == ["ID", "at", "n", "AMOUNT", "STATUS"]
    want = [(k, at, n, brute_at(changes, at).get(k), "x" if k in brute_at(changes, at) else None) for k, at, n in facts + facts[:5]]
    assert text(got.collect()) == text(want)


def test_empty_inputs(spark):
    found = change_rows(spark, made(4, 9))
    none = found.limit(0)
    facts = spark.createDataFrame([(1, 5, 1)], "ID long, at long, n int")
    assert history.row_versions(none, ["ID"]).count() == 0
    assert rows(history.as_of_join(facts, none, ["ID"], "at")) == [(1, 5, 1, None, None)]
    assert history.as_of_join(facts.limit(0), found, ["ID"], "at").count() == 0


def test_carried_forward_without_keys_and_with_burst(spark):
    data = [(n, None if n % 7 else n) for n in range(100)] + [(None, 5), (10**15, None)]
    frame = spark.createDataFrame(data, "p long, v long").repartition(3)
    got = carried_forward(frame, [], ["p"], F.col("v"), "last", F.col("p"), 13).collect()
    want = {n: n - n % 7 for n in range(100)} | {None: 5, 10**15: 98}
    assert {r.p: r["last"] for r in got} == want


# --- snapshots in chunks -------------------------------------------------------------


def test_chunks_cover_every_key_once(spark):
    data = [(k,) for k in [None, None, *range(100), 7, 7, 7]]
    frame = spark.createDataFrame(data, "ID long")
    plan = incremental.plan_chunks(frame, "ID", 20).orderBy("chunk").collect()
    assert len(plan) == 6 and plan[0].lower is None and plan[-1].upper is None
    parts = [frame.where(incremental.in_range("ID", c.lower, c.upper)).collect() for c in plan]
    assert sorted(str(r.ID) for p in parts for r in p) == sorted(str(k) for k, in data)
    alone = incremental.plan_chunks(frame.limit(0), "ID", 20).collect()
    assert [(c.chunk, c.lower, c.upper) for c in alone] == [(0, None, None)]


def test_chunk_rows_lose_to_changes_inside_the_window(spark):
    changes = events(spark, [
        event("u", 10, after=(1, "old", "x")), event("u", 11, after=(2, "b", "x")), event("d", 20, before=(3, "c", "x")),
        event("u", 15, before=(4, "d", "x"), after=(5, "e", "x")), event("u", 21, after=(6, "late", "x")),
    ])
    read = spark.createDataFrame([(k, f"r{k}", "x") for k in (1, 2, 3, 4, 5, 6, None)], "ID long, AMOUNT string, STATUS string")
    found = incremental.chunk_events(read, changes, ["ID"], 10, 20, 0, "CDC", "T")
    assert text((r.op, r.after.ID, r.source.scn) for r in found.collect()) == text([("r", 1, "20"), ("r", 6, "20"), ("r", None, "20")])
    known = spark.createDataFrame([(k, "k", "x") for k in (1, 2, 8, 3, 9)], read.schema)
    gone = incremental.chunk_deletes(known, read, changes, ["ID"], 10, 20, 0, "CDC", "T")
    assert text((r.op, r.before.ID, r.after) for r in gone.collect()) == text([("d", 8, None), ("d", 9, None)])


def test_snapshot_while_changes_go_on_and_after_a_stop(spark, path):
    changes = [(n, op, k, v) for n, (_, op, k, v) in enumerate(made(6, 300, hot=0.1))]
    found = change_rows(spark, changes)
    log = events(spark, [
        event(op, n, before=(k, v, "x") if op == "d" else None, after=None if op == "d" else (k, v, "x")) for n, op, k, v in changes
    ])
    target = TargetTable(spark, f"{path}/t", ["ID"])
    target.apply(found.where("_scn < 30"), "missed some")
    strays = change_rows(spark, [(0, "c", 100 + k, "stray") for k in range(5)])
    target.apply(strays, "strays")
    plan = incremental.plan_chunks(spark.range(15).toDF("ID"), "ID", 4)
    clock = {"now": 60}

    def position():
        clock["now"] += 20
        return clock["now"]

    calls = []

    def read_range(here):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("source went away")
        return history.state_as_of(found, ["ID"], clock["now"] + 9).where(here)

    args = (spark, plan, read_range, position, lambda: log, target, "ID", "CDC", "T", 0, f"{path}/work")
    with pytest.raises(RuntimeError, match="went away"):
        jobs.incremental_snapshot(*args)
    target.apply(found.where("_scn >= 200"), "newest first")
    target.apply(found.where("_scn BETWEEN 60 AND 220"), "live")
    steps = [(s.step, s.status) for s in jobs.incremental_snapshot(*args).collect()]
    assert steps == [("chunk-0", "KEPT"), ("chunk-1", "KEPT"), ("chunk-2", "DONE"), ("chunk-3", "DONE")]
    want = [(k, v, "x") for k, v in brute_at([(0, *c[1:]) for c in changes], 0).items()]
    assert text(target.read().collect()) == text(want)
    assert files.numbered(spark, f"{path}/work/done") == [0, 1, 2, 3]


# --- differences ------------------------------------------------------------------------


def test_row_diff(spark):
    rng = random.Random(7)
    left = {k: (rng.randint(0, 5), rng.choice([None, "a", "b"])) for k in [None, *range(400)]}
    right = dict(left)
    for k in (3, 50, None):
        del right[k]
    for k, v in {7: (left[7][0], "z"), 8: (9, left[8][1]), 9: (9, None if left[9][1] else "q"), 1000: (1, "n")}.items():
        right[k] = v
    frames = [spark.createDataFrame([(k, *v) for k, v in side.items()], "k long, n int, s string") for side in (left, right)]
    found = row_diff(frames[0], frames[1].repartition(3), ["k"], buckets=16).collect()
    got = {r.k: (r.difference, sorted(r.changed_columns)) for r in found}
    want = {3: ("missing", []), 50: ("missing", []), None: ("missing", []), 1000: ("extra", []),
            7: ("changed", ["s"]), 8: ("changed", ["n"]), 9: ("changed", ["n", "s"])}
    assert got == want and len(found) == len(want)
    row = next(r for r in found if r.k == 7)
    assert tuple(row.source_row) == left[7] and tuple(row.target_row) == right[7]
    assert row_diff(frames[0], frames[0].repartition(5), ["k"], buckets=16).count() == 0
    assert {r.difference for r in row_diff(frames[0].limit(0), frames[1], ["k"]).collect()} == {"extra"}
    twice = frames[0].unionByName(frames[0].where("k = 5"))
    assert [(r.k, r.difference) for r in row_diff(twice, frames[0], ["k"]).collect()] == [(5, "changed")]


def test_equal_buckets_are_not_shuffled(spark, path):
    spark.range(20_000).selectExpr("id AS k", "id * 2 AS v").write.parquet(f"{path}/s")
    source = spark.read.parquet(f"{path}/s")
    target = source.withColumn("v", F.when(F.col("k") == 77, 0).otherwise(F.col("v")))
    found = row_diff(source, target, ["k"])
    assert [(r.k, r.changed_columns) for r in found.collect()] == [(77, ["v"])]
    # One of 1024 ranges differs, so the second level reads one range and the last step a handful of rows.
    assert differing_buckets(*(d.withColumn("_upper", F.pmod(F.xxhash64("k"), F.lit(1024)).cast("int")) for d in (source, target)),
                             ["_upper"], ["k", "v"]).count() == 1
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
