"""Decisions on schema changes, kept in a log: the first valid one of an event counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.model import TABLE_EVENT
from tidemark.operators import ddl
from tidemark.sinks.stores import read_batches, record_events, write_batch

DECISION = T.StructType(
    [T.StructField("kafka_offset", T.LongType()), T.StructField("decided_at", T.TimestampNTZType())]
    + [
        T.StructField(c, T.StringType())
        for c in ("decision", "new_state", "schema_name", "table_name", "target_ddl", "note", "headline")
    ]
)


def decision_log(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """One row for each decided event: its first decision, should two writers have met."""
    rows = read_batches(spark, log, DECISION, before)
    first = Window.partitionBy("kafka_offset").orderBy("decided_at", "decision")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def with_decisions(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Schema changes in the state that the log says, with its note."""
    known = decided.select("kafka_offset", F.col("new_state").alias("_state"), F.col("note").alias("_note"))
    has_note = "note" in events.columns
    joined = events.join(known, "kafka_offset", "left").withColumns({
        "state": F.coalesce("_state", "state"),
        "note": F.coalesce("_note", "note") if has_note else F.col("_note"),
    })
    return joined.drop("_state", "_note")


def decide(
    spark: SparkSession, log: str, events: DataFrame, registry: DataFrame, decisions: DataFrame,
    at: datetime, batch_id: int, order: str | None = None, timeline: str | None = None,
) -> DataFrame:
    """Take a batch of decisions (kafka_offset, decision); the outcome of each, as ``resolve_ddl`` gives it.

    Valid ones go to the log, and to the timeline if there is one. An event that
    the log or an earlier decision of the batch (by ``order``) has decided is
    refused; without an order, contradicting decisions of one batch are both
    refused. A batch that is taken again under its id replaces its own rows.
    """
    valid_word = F.coalesce(F.col("decision").isin("APPROVE", "REJECT"), F.lit(False))
    place = F.col(order) if order else F.lit(0)
    known = decisions.where(valid_word).select("kafka_offset", "decision", place.alias("_place")).distinct()
    event = Window.partitionBy("kafka_offset")
    if order:
        later = F.row_number().over(event.orderBy("_place", "decision")) > 1
        judged = known.withColumn("_error", F.when(later, "already decided"))
    else:
        differ = F.min("decision").over(event) != F.max("decision").over(event)
        judged = known.withColumn("_error", F.when(differ, "contradicting decisions"))
    unknown = decisions.where(~valid_word)
    asked = judged.select("kafka_offset", "decision", "_error").unionByName(
        unknown.select("kafka_offset", "decision", F.lit("unknown decision").alias("_error")).distinct()
    )
    now = with_decisions(events, decision_log(spark, log, before=batch_id))
    taken = asked.where("_error IS NULL")
    resolved = ddl.resolve_ddl(now, registry, taken.select("kafka_offset", "decision"))
    stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    valid = resolved.where("error IS NULL").select(
        "kafka_offset", stamp.alias("decided_at"), "decision", "new_state", F.col("reg_schema").alias("schema_name"),
        F.col("reg_table").alias("table_name"), "target_ddl", "note", "headline",
    )
    write_batch(valid, log, batch_id)
    if timeline:
        record_events(decision_events(read_batches(spark, log, DECISION).where(F.col("decided_at") == stamp)), timeline)
    refused = asked.where("_error IS NOT NULL").select("kafka_offset", "decision", F.col("_error").alias("error"))
    return resolved.unionByName(refused, allowMissingColumns=True)


def decision_events(decided: DataFrame) -> DataFrame:
    """Timeline rows of decisions."""
    rejected = F.col("new_state") == "REJECTED"
    columns = {
        "event_id": F.col("kafka_offset"), "event_at": F.col("decided_at"),
        "event_type": F.concat(F.lit("DDL_"), F.col("new_state")),
        "severity": F.when(rejected, "WARN").otherwise("INFO"),
        "message": F.col("headline"), "detail": F.col("note"),
    }
    return decided.withColumns(columns).select(*[F.col(f.name).cast(f.dataType) for f in TABLE_EVENT.fields])


def paused_by_log(decided: DataFrame) -> DataFrame:
    """Tables whose apply is held back, because a change of theirs was rejected."""
    return decided.where("new_state = 'REJECTED'").select("schema_name", "table_name").distinct()
