"""Change events from messages, from whole tables, and their table filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.connect import from_wire, wire_type
from tidemark.functions.scalars import scn_long
from tidemark.model import SNAPSHOT_READ, SOURCE, envelope
from tidemark.sources.messages import unwrap

CORRUPT = "_corrupt"


def read_envelopes(
    messages: DataFrame,
    row: T.StructType,
    value_col: str = "value",
    source: T.StructType = SOURCE,
    on_error: str = "fail",
) -> DataFrame:
    """Change events from JSON messages, wrapped in ``{schema, payload}`` or bare.

    Messages without a value are tombstones for compaction and are skipped. A
    message that is not JSON, has a field of the wrong kind or no operation stops
    the job, or is skipped with ``on_error="drop"`` (see ``rejected``). Other
    columns of ``messages`` (offset, key, arrival time) are kept.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError(f"on_error must be fail or drop: {on_error}")
    event = envelope(row, source)
    parsed, fault = _parsed(messages, event, value_col)
    if on_error == "fail":
        stop = F.raise_error(F.concat(F.lit("bad message: "), fault)).cast("boolean")
        parsed = parsed.where(F.when(fault.isNotNull(), stop).otherwise(F.lit(True)))
    else:
        parsed = parsed.where(fault.isNull())
    typed = [
        from_wire(F.col("_body")[f.name], f.dataType).alias(f.name) for f in event.fields
    ]
    kept = [c for c in messages.columns if c != value_col]
    return parsed.select(*kept, *typed)


def _parsed(messages: DataFrame, event: T.StructType, value_col: str) -> tuple[DataFrame, Column]:
    """Messages with ``_body``, and what is wrong with each, null if nothing is."""
    raw = messages.withColumn("_raw", F.col(value_col))
    body = unwrap(raw, wire_type(event), value_col, corrupt=CORRUPT)
    fault = (
        F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("_body.op").isNull(), "no operation")
    )
    return body, fault


def rejected(
    messages: DataFrame, row: T.StructType, value_col: str = "value", source: T.StructType = SOURCE
) -> DataFrame:
    """The messages that ``read_envelopes`` does not take, unchanged, with ``reason``."""
    parsed, fault = _parsed(messages, envelope(row, source), value_col)
    kept = [F.col("_raw").alias(c) if c == value_col else F.col(c) for c in messages.columns]
    return parsed.where(fault.isNotNull()).select(*kept, fault.alias("reason"))


def snapshot_load(
    table: DataFrame, schema: str, name: str, scn: int | Column, ts_ms: int | Column
) -> DataFrame:
    """A whole table as snapshot-read events at one change number."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    image = F.struct(*[F.col(c) for c in table.columns])
    source = F.struct(
        as_col(scn).cast("string").alias("scn"),
        F.lit(None).cast("string").alias("txId"),
        as_col(ts_ms).cast("bigint").alias("ts_ms"),
        F.lit(schema).alias("schema"),
        F.lit(name).alias("table"),
    )
    row = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema.fields])
    return table.select(
        F.lit(SNAPSHOT_READ).alias("op"),
        F.lit(None).cast(row).alias("before"),
        image.alias("after"),
        source.alias("source"),
        as_col(ts_ms).cast("bigint").alias("ts_ms"),
    )


def changes_after(events: DataFrame, start_scn: int) -> DataFrame:
    """A start without data: only real changes past the starting point."""
    return events.where((F.col("op") != SNAPSHOT_READ) & (scn_long() > start_scn))


def include_list(registry: DataFrame) -> DataFrame:
    """One row: the ``SCHEMA.TABLE,...`` list of all registered tables."""
    names = F.sort_array(F.collect_list(F.concat_ws(".", "schema_name", "table_name")))
    return registry.agg(F.concat_ws(",", names).alias("include_list"))
