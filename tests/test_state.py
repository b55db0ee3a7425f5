import random

import pytest
from pyspark.sql import functions as F

from fixtures import FOUR, FOUR_STATE, event, events, rows
from tidemark.operators import replay, state


def test_four_events(spark):
    assert rows(state.current_state(events(spark, FOUR), ["ID"])) == FOUR_STATE


def test_duplicates_and_order_do_not_matter(spark):
    twice = [*FOUR[::-1], *FOUR]
    assert rows(state.current_state(events(spark, twice), ["ID"])) == FOUR_STATE


def test_numbers_not_text_decide_the_order(spark):
    data = [event("c", 999, after=(1, "a", "x")), event("u", 1000, after=(1, "b", "x"))]
    assert rows(state.current_state(events(spark, data), ["ID"])) == [(1, "b", "x")]


def test_delete_then_insert_again(spark):
    data = [event("c", 1, after=(1, "a", "x")), event("d", 2, before=(1, "a", "x")), event("c", 3, after=(1, "b", "x"))]
    assert rows(state.current_state(events(spark, data), ["ID"])) == [(1, "b", "x")]


def test_transaction_text_breaks_ties(spark):
    data = [event("u", 5, after=(1, "a", "x"), tx="t1"), event("u", 5, after=(1, "b", "x"), tx="t2"), event("u", 5, after=(1, "c", "x"))]
    assert rows(state.current_state(events(spark, data), ["ID"])) == [(1, "b", "x")]


def brute(changes):
    """Replay one by one, as a database would."""
    out = {}
    for scn, op, key, value in sorted(changes):
        if op == "d":
            out.pop(key, None)
        else:
            out[key] = value
    return sorted((k, v, "x") for k, v in out.items())


@pytest.fixture(scope="module")
def history():
    rng = random.Random(3)
    out = []
    for scn in range(400):
        key = 0 if rng.random() < 0.4 else rng.randrange(30)
        out.append((scn, rng.choice("ccuudr"), key, f"v{scn}"))
    return out


def as_events(spark, changes):
    data = []
    for scn, op, key, value in changes:
        image = (key, value, "x")
        data.append(event(op, scn, before=image if op == "d" else None, after=None if op == "d" else image))
    return events(spark, data).repartition(4)


def test_fold_is_a_replay(spark, history):
    assert rows(state.current_state(as_events(spark, history), ["ID"])) == brute(history)


@pytest.mark.parametrize("small", [True, False])
def test_merge_equals_fold_for_any_cut_overlap_and_order(spark, history, small):
    full = state.change_rows(as_events(spark, history))
    want = brute(history)
    for cut, back in [(100, 0), (200, 60), (399, 399)]:
        old = state.fold(full.where(F.col("_scn") < cut), ["ID"])
        new = full.where(F.col("_scn") >= cut - back)
        once = state.merge_batch(old, new, ["ID"], small)
        assert rows(state.live(once)) == want
        # Again, and with an old batch that comes late.
        late = full.where(F.col("_scn") < 50)
        again = state.merge_batch(state.merge_batch(once, new, ["ID"], small), late, ["ID"], small)
        assert rows(state.live(again)) == want


def test_small_batch_does_not_shuffle_the_state(spark, history):
    full = state.change_rows(as_events(spark, history))
    old = state.fold(full, ["ID"])
    merged = state.merge_batch(old, full.where("_scn > 390"), ["ID"])
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_replay_floor_is_inclusive_and_drops_bad_numbers(spark):
    data = [*FOUR, event("c", "x1", after=(7, "a", "b")), event("c", None, after=(8, "a", "b")), event("c", " 1500", after=(9, "a", "b"))]
    got = replay.from_scn(events(spark, data), 1010).select("source.scn")
    assert rows(got) == [("1010",), ("1020",), ("1030",)]


def test_replay_twice_is_replay_once(spark, history):
    df = as_events(spark, history)
    part = replay.from_scn(df, 250)
    once = state.current_state(part, ["ID"])
    assert rows(state.current_state(part.unionByName(part), ["ID"])) == rows(once)
    assert rows(state.current_state(replay.from_scn(df, 0), ["ID"])) == brute(history)


def test_replay_order(spark):
    data = [event("c", 10, after=(1, "", ""), tx="b"), event("c", 9, after=(2, "", ""), tx="z"), event("c", 10, after=(3, "", "")), event("c", 10, after=(4, "", ""), tx="a")]
    got = [r[0] for r in replay.replay_order(events(spark, data)).select("after.ID").collect()]
    assert got == [2, 3, 4, 1]


def test_key_change_splits_into_delete_and_create(spark):
    data = [event("c", 1, after=(1, "a", "x")), event("u", 2, before=(1, "a", "x"), after=(5, "a", "x"))]
    df = events(spark, data)
    assert rows(state.current_state(df, ["ID"])) == [(1, "a", "x"), (5, "a", "x")]
    assert rows(state.current_state(state.expand_key_changes(df, ["ID"]), ["ID"])) == [(5, "a", "x")]
