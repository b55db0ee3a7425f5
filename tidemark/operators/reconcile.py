"""Comparing a source table with its target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import Columnish
from tidemark.functions.text import row_text


def row_hash(columns: Sequence[Columnish]) -> Column:
    """First 32 bits of the MD5 of the row text, a hash any database can compute too."""
    head = F.substring(F.md5(row_text(columns)), 1, 8)
    return F.conv(head, 16, 10).cast("bigint")


def checksum(df: DataFrame, columns: Sequence[Columnish]) -> DataFrame:
    """One row: row count and the sum of row hashes, whatever the row order.

    The two 16-bit halves are summed apart. Each sum stays inside 64 bits for
    10^14 rows, and only the final addition needs a wide decimal.
    """
    h = row_hash(columns)
    high, low = F.sum(F.shiftright(h, 16)), F.sum(h.bitwiseAND(F.lit(65535)))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,0)")
    total = wide(high) * F.lit(65536).cast("decimal(5,0)") + wide(low)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), total.cast("decimal(38,0)").alias("checksum")
    )


def reconcile(
    source: DataFrame, target: DataFrame, columns: Sequence[Columnish]
) -> DataFrame:
    """One row: counts and checksums of both sides, and whether they match."""
    sides = (
        checksum(source, columns)
        .withColumn("side", F.lit("s"))
        .unionByName(checksum(target, columns).withColumn("side", F.lit("t")))
    )
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = sides.agg(
        pick("s", "row_count").alias("source_rows"),
        pick("t", "row_count").alias("target_rows"),
        pick("s", "checksum").alias("source_checksum"),
        pick("t", "checksum").alias("target_checksum"),
    )
    same = (F.col("source_rows") == F.col("target_rows")) & (
        F.col("source_checksum") == F.col("target_checksum")
    )
    return out.withColumn("matched", same)


def orphans(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key the source does not have."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their row count."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | has_null)


def target_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per target table; an empty gate is one where all are zero."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def missing_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Source columns the target cannot take, because absent or of another type."""
    have = {f.name.upper(): f.dataType for f in target.schema.fields}
    return [f.name for f in source.schema.fields if have.get(f.name.upper()) != f.dataType]
