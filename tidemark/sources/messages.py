"""JSON messages that may come wrapped in ``{schema, payload}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def unwrap(
    messages: DataFrame, body: T.StructType, value: str = "value", corrupt: str | None = None
) -> DataFrame:
    """Replace the value column by ``_body``, the message or its payload.

    Messages without a value are left out. The parse sits in a generator: a plain
    projection would be merged into its readers and run once per field read.
    ``corrupt`` names a further column: the text of a message that does not parse
    in full, else null.
    """
    both = T.StructType([T.StructField("payload", body)] + body.fields)
    kept = [c for c in messages.columns if c != value]
    options = {"mode": "PERMISSIVE"}
    if corrupt:
        both = both.add(corrupt, T.StringType())
        options["columnNameOfCorruptRecord"] = corrupt
    parsed = F.from_json(value, both, options)
    rows = messages.where(F.col(value).isNotNull()).select(*kept, F.explode(F.array(parsed)).alias("_m"))
    bare = F.struct(*[F.col("_m")[f.name].alias(f.name) for f in body.fields])
    whole = [F.col("_m")[corrupt].alias(corrupt)] if corrupt else []
    return rows.select(*kept, *whole, F.coalesce(F.col("_m.payload"), bare).alias("_body"))


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]
