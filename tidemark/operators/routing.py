"""Which changelog or registered table something belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import changelog_name, table_suffix
from tidemark.operators.lookup import lookup


def route(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of registered tables with the changelog they go to, by schema and table."""
    names = registry.select(
        F.col("schema_name").alias("_schema"),
        F.col("table_name").alias("_table"),
        changelog_name("schema_name", "table_name").alias("changelog_table"),
    ).distinct()
    on = {"_schema": F.col("source.schema"), "_table": F.col("source.table")}
    return lookup(events, names, on, ["source", "ts_ms"]).drop("_schema", "_table")


def of_tables(events: DataFrame, tables: DataFrame, how: str) -> DataFrame:
    """Events whose table is (``left_semi``) or is not (``left_anti``) among some tables."""
    names = tables.select(
        F.col("schema_name").alias("_schema"), F.col("table_name").alias("_table")
    ).distinct()
    on = {"_schema": F.col("source.schema"), "_table": F.col("source.table")}
    return lookup(events, names, on, ["source", "ts_ms"], how)


def include_tables(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of registered tables only."""
    return of_tables(events, registry, "left_semi")


def exclude_paused(events: DataFrame, paused: DataFrame) -> DataFrame:
    """Events to apply: those of paused tables are held back, not lost."""
    return of_tables(events, paused, "left_anti")


def attribute(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Connector names with the table they work for.

    A table matches when the name ends in its suffix; of several the first by
    schema and table. Without a match the only registered table is taken, if
    there is just one. Every ending of a name that is as long as the shortest
    suffix is looked up by equality, so the join stays an equi join for any
    number of names and tables, and no short ending gathers many names. Names
    without a match stay through the join, so they are not joined again.
    """
    tables = registry.select(
        "schema_name", "table_name", table_suffix("schema_name", "table_name").alias("_end")
    )
    firsts = tables.groupBy("_end").agg(
        F.min(F.struct("schema_name", "table_name")).alias("_table")
    )
    distinct = names.select(name).distinct()
    shortest = F.coalesce(firsts.agg(F.min(F.length("_end"))).scalar(), F.lit(1))
    last = F.length(name) - F.greatest("_shortest", F.lit(1)) + 1
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    endings = distinct.withColumn("_shortest", shortest).select(
        name,
        F.explode(F.transform(starts, lambda i: F.col(name).substr(i, F.length(name)))).alias("_end"),
    )
    # Sizes estimated from the input do not count the endings of a name, so neither side is to be broadcast.
    found = (
        endings.join(firsts.hint("merge"), "_end", "left").groupBy(name).agg(F.min("_table").alias("_table"))
    )
    only = registry.agg(
        F.when(
            F.count(F.lit(1)) == 1, F.min(F.struct("schema_name", "table_name"))
        ).alias("_only")
    )
    table = F.coalesce("_table", only.scalar())
    return (
        found.withColumn("_table", table)
        .select(
            name,
            F.coalesce(F.col("_table.schema_name"), F.lit("-")).alias("schema_name"),
            F.coalesce(F.col("_table.table_name"), F.col(name)).alias("table_name"),
        )
    )
