"""Schema changes: parse, classify, store once, decide, retarget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.text import first_line, is_blank, is_ignorable, retarget_ddl
from tidemark.operators.lookup import lookup
from tidemark.sources.messages import strings, unwrap

# The parts of a schema-change message that are used.
_MESSAGE = T.StructType(
    [
        *strings("ddl", "ts_ms"),
        T.StructField("source", T.StructType(strings("snapshot", "scn"))),
        T.StructField("tableChanges", T.ArrayType(T.StructType(strings("id")))),
    ]
)


def parse_ddl(messages: DataFrame, value: str = "value", offset: str = "kafka_offset") -> DataFrame:
    """One row per message with a statement; anything else is skipped.

    The snapshot flag is on for any text but "false". The table comes from the
    first table change, cut at its first dot, quotes removed.
    """
    rows = unwrap(messages, _MESSAGE, value)
    ident = F.replace(F.get("_body.tableChanges", 0)["id"], F.lit('"'), F.lit(""))
    dot = F.instr(ident, ".")
    snapshot = F.lower(F.coalesce("_body.source.snapshot", F.lit("false"))) != "false"
    return rows.where(~is_blank("_body.ddl")).select(
        offset,
        F.coalesce(F.col("_body.ts_ms").try_cast("bigint"), F.lit(0)).alias("event_ts_ms"),
        F.col("_body.source.scn").alias("scn"),
        F.when(dot > 1, ident.substr(F.lit(1), dot - 1)).alias("schema_name"),
        F.when(dot > 1, ident.substr(dot + 1, F.length(ident))).alias("table_name"),
        F.col("_body.ddl").alias("ddl_text"),
        snapshot.alias("is_snapshot"),
    )


def initial_state(is_snapshot: Column, ddl: Column) -> Column:
    return (
        F.when(is_snapshot, "SNAPSHOT").when(is_ignorable(ddl), "IGNORED").otherwise("DETECTED")
    )


def classify_ddl(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("state", initial_state(F.col("is_snapshot"), F.col("ddl_text")))


def new_ddl_events(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Events whose offset is not stored yet, each offset once."""
    fresh = incoming.dropDuplicates(["kafka_offset"])
    return fresh.join(existing.select("kafka_offset").distinct(), "kafka_offset", "left_anti")


def match_registered(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of registered tables, with the registry columns, names compared without case.

    Of entries whose names differ in case only the first by schema and table counts.
    """
    entry = F.struct(
        F.col("schema_name").alias("reg_schema"),
        F.col("table_name").alias("reg_table"),
        F.coalesce("target_schema", "schema_name").alias("target_schema"),
        F.coalesce("target_table", "table_name").alias("target_table"),
    )
    tables = (
        registry.groupBy(F.upper("schema_name").alias("_s"), F.upper("table_name").alias("_t"))
        .agg(F.min(entry).alias("_entry"))
        .select("_s", "_t", "_entry.*")
    )
    on = {"_s": F.upper("schema_name"), "_t": F.upper("table_name")}
    return lookup(events, tables, on, ["kafka_offset"]).drop("_s", "_t")


def with_target_ddl(matched: DataFrame) -> DataFrame:
    return matched.withColumn(
        "target_ddl",
        retarget_ddl("ddl_text", "reg_schema", "reg_table", "target_schema", "target_table"),
    )


def resolve_ddl(events: DataFrame, registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of each decision (kafka_offset, decision APPROVE or REJECT).

    Only a DETECTED event of a registered table can be decided. An approval
    carries the statement to run on the target, a rejection pauses the table.
    """
    columns = ["kafka_offset", "schema_name", "table_name", "ddl_text", "state"]
    found = decisions.join(events.select(*columns), "kafka_offset", "left")
    tables = registry.select("schema_name", "table_name", "target_schema", "target_table")
    known = with_target_ddl(match_registered(events.select(*columns), tables)).select(
        "kafka_offset", "reg_schema", "reg_table", "target_schema", "target_table", "target_ddl"
    )
    rows = found.join(known, "kafka_offset", "left")
    error = (
        F.when(F.col("ddl_text").isNull(), "no such event")
        .when(F.col("state") != "DETECTED", "not waiting for a decision")
        .when(F.col("reg_table").isNull(), "table is not registered")
    )
    ok = F.col("error").isNull()
    approved = ok & (F.col("decision") == "APPROVE")
    rejected = ok & (F.col("decision") == "REJECT")
    note = F.when(F.col("target_ddl") == F.col("ddl_text"), "applied to target").otherwise(
        F.concat(F.lit("applied as "), F.concat_ws(".", "target_schema", "target_table"))
    )
    return (
        rows.withColumn("error", error)
        .withColumn(
            "new_state",
            F.when(approved, "APPROVED").when(rejected, "REJECTED").otherwise(F.col("state")),
        )
        .select(
            "kafka_offset",
            "decision",
            "reg_schema",
            "reg_table",
            "new_state",
            F.when(approved, F.col("target_ddl")).alias("target_ddl"),
            F.when(approved, note).when(rejected, "apply paused").alias("note"),
            F.when(ok, first_line("ddl_text")).alias("headline"),
            "error",
        )
    )


def paused_tables(resolved: DataFrame) -> DataFrame:
    return (
        resolved.where(F.col("new_state") == "REJECTED")
        .where(F.col("error").isNull())
        .select(F.col("reg_schema").alias("schema_name"), F.col("reg_table").alias("table_name"))
        .distinct()
    )


def ddl_history(events: DataFrame, state: str | None = None) -> DataFrame:
    """Newest first, optionally of one state."""
    if state is not None:
        events = events.where(F.col("state") == state)
    return events.orderBy(F.col("kafka_offset").desc())
