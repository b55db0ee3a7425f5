"""Packing small files, and what commits leave behind."""

import json
import os

import pytest

from fixtures import T0, event, events, rows
from tidemark.model import DAY_MS
from tidemark.operators import state
from tidemark.sinks import changelog as log, files


@pytest.fixture
def where(spark, path):
    where = log.table_path(path, "CDC", "ORDERS")
    for n in range(6):
        data = [event("u", 10 * k + n, after=(k % 7, f"v{10 * k + n}", "x"), ts_ms=T0 + k % 2 * DAY_MS) for k in range(40)]
        log.append_changelog(events(spark, data), where, f"c{n}")
    return where


def content(spark, where):
    stored = log.scan_changelog(spark, where)
    return rows(stored.select("scn_num", "commit_id", "commit_seq", "ingest_seq", "p_ts_ms", "after.AMOUNT"))


def n_files(where):
    return sum(f.endswith(".parquet") for d in os.listdir(where) if d.startswith("p_ts_ms=") for f in os.listdir(f"{where}/{d}"))


def test_packing_keeps_rows_and_order(spark, where):
    before, many = content(spark, where), n_files(where)
    now = rows(state.current_state(log.scan_changelog(spark, where), ["ID"]))
    assert len(log.compact_changelog(spark, where)) == 2
    assert n_files(where) == 2 < many and content(spark, where) == before
    assert rows(state.current_state(log.scan_changelog(spark, where), ["ID"])) == now
    assert log.compact_changelog(spark, where) == [] and not os.path.exists(f"{where}/_packed")
    day = next(d for d in os.listdir(where) if d.startswith("p_ts_ms="))
    packed = [r.scn_num for r in spark.read.parquet(f"{where}/{day}").select("scn_num").collect()]
    assert packed == sorted(packed)
    plan = log.scan_changelog(spark, where).where("scn_num >= 200")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(scn_num,200)" in plan
    summary = log.changelog_summary(log.scan_changelog(spark, where)).first()
    report = log.changelog_report(spark, where).first()
    assert (summary.records, summary.files, summary.commits) == (240, 2, 6) == (report.records, report.files, report.commits)
    assert summary.bytes == report.bytes


def test_files_of_a_size_stay_and_parts_cover_ranges(spark, where):
    largest = max(s for d in os.listdir(where) if d.startswith("p_ts_ms=") for s in files.listing(spark, f"{where}/{d}").values())
    before = content(spark, where)
    log.compact_changelog(spark, where, file_bytes=largest * 3)
    assert content(spark, where) == before and 2 < n_files(where) < 12
    for day in (d for d in os.listdir(where) if d.startswith("p_ts_ms=")):
        bounds = sorted(
            (min(v), max(v)) for v in (
                [r.scn_num for r in spark.read.parquet(f"{where}/{day}/{f}").collect()] for f in files.listing(spark, f"{where}/{day}")
            )
        )
        assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert log.compact_changelog(spark, where, file_bytes=2) == []


def test_packing_that_was_broken_off(spark, where, monkeypatch):
    before = content(spark, where)
    real = files.remove
    calls = []

    def stop(spark, path):
        if path.endswith(".parquet"):
            calls.append(path)
            if len(calls) == 3:
                raise OSError("gone")
        return real(spark, path)

    monkeypatch.setattr(files, "remove", stop)
    with pytest.raises(OSError, match="gone"):
        log.compact_changelog(spark, where)
    # Some events are there twice, none is missing, and readers fold them away.
    assert set(content(spark, where)) == set(before)
    monkeypatch.setattr(files, "remove", real)
    log.compact_changelog(spark, where)
    assert content(spark, where) == before
    os.makedirs(f"{where}/_packed/p_ts_ms=1")
    log.compact_changelog(spark, where)
    assert content(spark, where) == before and not os.path.exists(f"{where}/_packed")


def test_commit_notes_are_put_together(spark, path, monkeypatch):
    monkeypatch.setattr(log, "_COMMIT_FILES", 4)
    for n in range(11):
        log._record_commit(spark, path, {"commit_id": f"c{n}", "committed_ms": n, "records": n, "min_scn": None, "max_scn": n})
    assert len(files.numbered(spark, f"{path}/_commits")) <= 5
    # A note that could not be removed is not counted again.
    files.write_text(spark, f"{path}/_commits/3.json", json.dumps({"n": 3, "commit_id": "c3", "committed_ms": 3, "records": 3}))
    found = log.changelog_commits(spark, path)
    assert sorted(r.records for r in found.collect()) == list(range(11))
    assert log.changelog_commits(spark, f"{path}/none").count() == 0
