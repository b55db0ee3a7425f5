"""Rows in which a source and its target differ, found by a tree of checksums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.reconcile import row_hash

#: Buckets on each of the two levels: at most 2^20 small rows are broadcast.
BUCKETS = 1024


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows with their bucket on both levels, both from the key alone."""
    h = F.xxhash64(*keys)
    return df.withColumns({
        "_upper": F.pmod(h, F.lit(buckets)).cast("int"),
        "_lower": F.pmod(F.floor(h / buckets), F.lit(buckets)).cast("int"),
    })


def _sums(df: DataFrame, level: Sequence[str], columns: Sequence[str], side: int) -> DataFrame:
    h = row_hash(columns)
    return df.groupBy(*level).agg(
        F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.sum(h.bitwiseAND(F.lit(0xFFFF)) * F.shiftright(h, 16)).alias("p")
    ).withColumn("side", F.lit(side))


def differing_buckets(
    source: DataFrame, target: DataFrame, level: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Buckets whose row counts or checksums are not the same on both sides."""
    both = _sums(source, level, columns, 1).unionByName(_sums(target, level, columns, -1))
    difference = [F.sum(F.col(c) * F.col("side")) for c in ("n", "s", "p")]
    unequal = reduce(lambda a, b: a | b, (d != 0 for d in difference))
    return both.groupBy(*level).agg(unequal.alias("unequal")).where("unequal").select(*level)


def row_diff(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per differing key: keys, difference, changed_columns, source_row and target_row.

    ``difference`` is ``missing`` (in the target), ``extra`` or ``changed``;
    ``columns`` are those to compare, all others of the source by default. First
    the checksums of ``buckets`` hash ranges of the key are compared, then those
    of as many parts of each range that differs. Only rows in parts that differ
    are shuffled; equal tables end after one pass that shuffles a few numbers
    per task. Null keys are keys like any other. A key that occurs more often on
    one side counts as changed; of its rows the largest is shown.

    Hashes have 32 bits and their sums are compared with counts and a second
    sum, so a change inside a part goes unseen with a chance of about 2^-32.
    """
    columns = [c for c in source.columns if c not in keys] if columns is None else list(columns)
    compared = [*keys, *columns]
    sides = [_bucketed(df.select(*compared), keys, buckets) for df in (source, target)]

    upper = F.broadcast(differing_buckets(*sides, ["_upper"], compared))
    sides = [df.join(upper, "_upper", "left_semi") for df in sides]
    lower = F.broadcast(differing_buckets(*sides, ["_upper", "_lower"], compared))
    left, right = (
        df.join(lower, ["_upper", "_lower"], "left_semi").select(*compared, F.lit(side).alias("_side"))
        for df, side in zip(sides, (1, -1), strict=True)
    )

    def here(side: int) -> Column:
        return F.col("_side") == side

    def unequal(c: str) -> Column:
        return F.sum(F.coalesce(row_hash([c]), F.lit(0)) * F.col("_side")) != 0

    image = F.struct(*columns) if columns else F.struct(F.lit(None).alias("none"))
    grouped = left.unionByName(right).groupBy(*keys).agg(
        F.count_if(here(1)).alias("_s"), F.count_if(here(-1)).alias("_t"),
        F.max(F.when(here(1), image)).alias("source_row"), F.max(F.when(here(-1), image)).alias("target_row"),
        F.filter(F.array(*[F.when(unequal(c), F.lit(c)) for c in columns]).cast("array<string>"), lambda c: c.isNotNull()).alias("_unequal"),
    )
    found = (
        F.when(F.col("_t") == 0, "missing").when(F.col("_s") == 0, "extra")
        .when((F.col("_s") != F.col("_t")) | (F.size("_unequal") > 0), "changed")
    )
    changed = F.when(F.col("difference") == "changed", F.col("_unequal")).otherwise(F.array().cast("array<string>"))
    return grouped.withColumn("difference", found).where("difference IS NOT NULL").select(
        *keys, "difference", changed.alias("changed_columns"), "source_row", "target_row"
    )
