"""Order-dependent logic per key that survives hot keys.

A window over ``partitionBy(key)`` puts a whole key into one task. A connector,
topic or table that produces a third of all rows would stall such a job. Here a
hot key is cut along its order column into slices of a fixed width, and each
slice is one window group. What a slice needs from the rows before it is put in
front of it as *seed* rows, which come from one summary per earlier slice and
are taken out again after the window. The rows themselves are shuffled once.

Only hot keys are cut. Which keys are hot changes the speed and never the
result, so they are counted on the rows in one of 64 hash classes of the order
columns. At most ``rows / hot_rows`` keys can pass, which bounds the broadcast.
When none passes, adaptive execution sees the empty list and drops the seeds,
and the job is the plain window again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 5_000_000
_CLASSES = 64
_SLICE, _SEED = "_ordered_slice", "_ordered_seed"
_NO_POSITION = -(2**62)


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(_SEED).desc(), *[F.col(c).asc_nulls_first() for c in order]]


def _hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int) -> DataFrame:
    if hot_rows >= 1000 * _CLASSES:
        df = df.where(F.pmod(F.xxhash64(*order), F.lit(_CLASSES)) == 0)
        hot_rows //= _CLASSES
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    names = [F.col(k).alias("_hot_" + k) for k in keys]
    return counts.where(F.col("_n") > hot_rows).select(*names, F.lit(True).alias("_hot"))


def sliced(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``_ordered_slice``: the row's slice for hot keys, null for the rest.

    ``position`` is a number that never falls as the order advances, such as a
    change number, an offset or epoch millis. Without keys the whole table is
    one sequence, and every row is in a slice.
    """
    cell = F.coalesce(position - F.pmod(position, F.lit(width)), F.lit(_NO_POSITION))
    if not keys:
        return df.withColumn(_SLICE, cell)
    hot = _hot_keys(df, keys, order, hot_rows)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot["_hot_" + k]) for k in keys])
    joined = df.join(F.broadcast(hot), same, "left")
    joined = joined.withColumn(_SLICE, F.when(F.col("_hot"), cell))
    return joined.drop("_hot", *["_hot_" + k for k in keys])


def _summaries(df: DataFrame, keys: Sequence[str], summary: Column) -> DataFrame:
    rows = df.where(F.col(_SLICE).isNotNull())
    return rows.groupBy(*keys, _SLICE).agg(summary.alias("_summary"))


def _seeded(df: DataFrame, seeds: DataFrame) -> DataFrame:
    data = df.withColumn(_SEED, F.lit(False))
    return data.unionByName(seeds.withColumn(_SEED, F.lit(True)), allowMissingColumns=True)


def _unseeded(df: DataFrame, *helpers: str) -> DataFrame:
    return df.where(~F.col(_SEED)).drop(_SEED, _SLICE, *helpers)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
    present: str | None = None,
) -> DataFrame:
    """Add columns holding values of the preceding row of the same key.

    ``values`` maps a new column name to the column it looks back at. ``order``
    must be a total order within a key. ``present`` names a boolean column that
    is true when a preceding row exists, for values that may be null.
    """
    df = sliced(df, keys, order, position, width, hot_rows)
    looked_at = list(dict.fromkeys(values.values()))
    last = F.max_by(F.struct(*looked_at), F.struct(*order))
    before = F.lag("_summary").over(Window.partitionBy(*keys).orderBy(_SLICE))
    seeds = (
        _summaries(df, keys, last)
        .withColumn("_summary", before)
        .where(F.col("_summary").isNotNull())
        .select(*keys, _SLICE, *[F.col("_summary")[c].alias(c) for c in looked_at])
    )
    w = Window.partitionBy(*keys, _SLICE).orderBy(*_order(order))
    out = {dst: F.lag(src).over(w) for dst, src in values.items()}
    if present:
        out[present] = F.row_number().over(w) > 1
    return _unseeded(_seeded(df, seeds).withColumns(out))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to this one."""
    df = sliced(df.withColumn("_v", value), keys, order, position, width, hot_rows)
    slices = Window.partitionBy(*keys).orderBy(_SLICE)
    before = F.sum("_summary").over(slices.rowsBetween(Window.unboundedPreceding, -1))
    seeds = (
        _summaries(df, keys, F.sum("_v"))
        .select(*keys, _SLICE, before.alias("_v"))
        .where(F.col("_v").isNotNull())
    )
    w = Window.partitionBy(*keys, _SLICE).orderBy(*_order(order))
    total = F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _unseeded(_seeded(df, seeds).withColumn(out, total), "_v")


def recent_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    n: int,
    out: str,
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the key's last ``n`` values up to and including this row.

    A slice hands on its last ``n - 1`` values. Every slice has at least one row,
    so the ``n - 1`` slices before this one always hold all that is needed.
    """
    look = n - 1
    df = sliced(df, keys, order, position, width, hot_rows)
    group = Window.partitionBy(*keys, _SLICE)
    newest = group.orderBy(*[F.col(c).desc_nulls_last() for c in order])
    # Rank in front, negated: sorting the list gives the values back in order.
    tail = F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v"))))
    tails = (
        df.where(F.col(_SLICE).isNotNull())
        .select(*keys, _SLICE, value, *[c for c in order if c != value])
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= look)
    )
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(-look, -1)
    handed = F.flatten(F.collect_list("_summary").over(before))
    kept = F.slice(F.col("_t"), F.greatest(F.lit(1), F.size("_t") - (look - 1)), max(look, 1))
    seeds = (
        _summaries(tails, keys, tail)
        .select(*keys, _SLICE, handed.alias("_t"))
        .select(*keys, _SLICE, F.posexplode(kept).alias("_at", "_e"))
        .select(*keys, _SLICE, "_at", F.col("_e.v").alias(value))
    )
    first, *rest = _order(order)
    both = _seeded(df, seeds)
    w = group.orderBy(first, F.col("_at").asc_nulls_first(), *rest).rowsBetween(-look, 0)
    return _unseeded(both.withColumn(out, F.collect_list(value).over(w)), "_at")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; ``order`` lists descending sort columns.

    The rank filter is applied on the map side as well, so a key leaves each
    map task as one row at most, hot or not.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def carried_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    position: Column,
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the key's last ``value`` that is not null, up to and including this row."""
    df = sliced(df.withColumn("_v", value), keys, order, position, width, hot_rows)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    slices = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        _summaries(df, keys, last)
        .select(*keys, _SLICE, F.last("_summary", ignorenulls=True).over(slices).alias("_v"))
        .where(F.col("_v").isNotNull())
    )
    w = Window.partitionBy(*keys, _SLICE).orderBy(*_order(order))
    found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _unseeded(_seeded(df, seeds).withColumn(out, found), "_v")
