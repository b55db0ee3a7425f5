"""Snapshots in chunks while changes go on.

A chunk of a table is read between two change numbers, the low and the high
one. What it read may be older or newer than a change in between, so a chunk
row whose key changed inside the window is left out: the change itself brings
the row. All others were the same throughout the window, and stand in the
history as reads at the high number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import scn_long
from tidemark.model import DELETE
from tidemark.sources.envelopes import snapshot_load


def plan_chunks(source: DataFrame, key: str, chunk_rows: int, accuracy: int = 10_000) -> DataFrame:
    """Chunks as ranges of a numeric or date key: chunk, lower (exclusive), upper (inclusive).

    The bounds are approximate quantiles from one aggregation. The first range
    has no lower bound and the last no upper one, so rows that arrive later
    belong to a chunk too; null keys belong to the first.
    """
    n = source.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    chunks = max(1, -(-n // chunk_rows))
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)]).cast("array<double>")
    bounds = F.array_distinct(F.percentile_approx(key, shares, accuracy)) if chunks > 1 else F.array().cast(
        f"array<{source.schema[key].dataType.simpleString()}>"
    )
    ends = source.agg(F.coalesce(bounds, F.array()).alias("b"))
    none = F.lit(None).cast(source.schema[key].dataType)
    ranges = F.arrays_zip(
        F.concat(F.array(none), "b").alias("lower"), F.concat("b", F.array(none)).alias("upper")
    )
    return ends.select(F.posexplode(ranges).alias("chunk", "r")).select("chunk", "r.lower", "r.upper")


def in_range(key: str, lower, upper) -> Column:
    """The condition of one planned chunk, which sources can push down."""
    above = F.lit(True) if lower is None else F.col(key) > lower
    below = F.lit(True) if upper is None else F.col(key) <= upper
    return (above & below) | (F.col(key).isNull() if lower is None else F.lit(False))


def _untouched(rows: DataFrame, changes: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Rows whose key has no change above ``low`` up to ``high``; a moved key counts as old and as new."""
    scn = F.col("scn_num") if "scn_num" in changes.columns else scn_long("source.scn")
    window = changes.where((scn > low) & (scn <= high))
    old, new = (
        window.where(F.col(i).isNotNull()).select(*[F.col(i)[k].alias(f"_c_{k}") for k in keys])
        for i in ("before", "after")
    )
    return rows.join(old.unionByName(new).distinct(), _same(keys, "_c_"), "left_anti")


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys))


def chunk_events(
    rows: DataFrame, changes: DataFrame, keys: Sequence[str], low: int, high: int, ts_ms: int,
    schema: str, table: str,
) -> DataFrame:
    """Read events of a chunk that was read between change numbers ``low`` and ``high``.

    ``changes`` are change events that hold at least those above ``low`` up to
    ``high``; only the keys of this window are read.
    """
    return snapshot_load(_untouched(rows, changes, keys, low, high), schema, table, high, ts_ms)


def chunk_deletes(
    known: DataFrame, rows: DataFrame, changes: DataFrame, keys: Sequence[str], low: int, high: int,
    ts_ms: int, schema: str, table: str,
) -> DataFrame:
    """Delete events for rows that the target has in a chunk's range and the source no longer has.

    These are deletes that the target missed. A key that changed inside the
    window may have come or gone in it and is left to its change.
    """
    here = rows.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    gone = _untouched(known.join(here, _same(keys, "_h_"), "left_anti"), changes, keys, low, high)
    events = snapshot_load(gone, schema, table, high, ts_ms)
    none = F.lit(None).cast(events.schema["after"].dataType)
    return events.withColumns({"op": F.lit(DELETE), "before": F.col("after"), "after": none})
