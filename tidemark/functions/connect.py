"""Connect JSON: ``{"schema": ..., "payload": ...}`` for keys and values, both ways.

The schema half is the same for every row, so the driver builds it once and it
travels as a literal. The payload half is ``to_json`` over type-mapped columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.scalars import ntz_millis

# Names under which logical types and the two structs travel.
DECIMAL_NAME = "org.apache.kafka.connect.data.Decimal"
DATE_NAME = "org.apache.kafka.connect.data.Date"
TIMESTAMP_NAME = "org.apache.kafka.connect.data.Timestamp"
VALUE_NAME = "recovery.Envelope"
KEY_NAME = "recovery.Key"

_PLAIN = {
    T.BooleanType: "boolean",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.StringType: "string",
    T.BinaryType: "bytes",
}

_TWO_64 = "cast(18446744073709551616 as decimal(20,0))"


class UnsupportedType(ValueError):
    """A column type that has no place in a change event."""


# --- schema half -------------------------------------------------------------


def _field_schema(dtype: T.DataType, optional: bool) -> dict:
    if isinstance(dtype, T.DecimalType):
        return {
            "type": "bytes",
            "name": DECIMAL_NAME,
            "version": 1,
            "parameters": {
                "scale": str(dtype.scale),
                "connect.decimal.precision": str(dtype.precision),
            },
            "optional": optional,
        }
    if isinstance(dtype, T.DateType):
        return {"type": "int32", "name": DATE_NAME, "version": 1, "optional": optional}
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "int64", "name": TIMESTAMP_NAME, "version": 1, "optional": optional}
    if isinstance(dtype, T.StructType):
        return {**_struct_schema(dtype), "optional": optional}
    for known, name in _PLAIN.items():
        if isinstance(dtype, known):
            return {"type": name, "optional": optional}
    raise UnsupportedType(f"type not supported in a change event: {dtype.simpleString()}")


def _struct_schema(struct: T.StructType, name: str | None = None) -> dict:
    head = {"type": "struct"} if name is None else {"type": "struct", "name": name}
    fields = [{**_field_schema(f.dataType, True), "field": f.name} for f in struct.fields]
    return {**head, "optional": True, "fields": fields}


def _dumps(value: dict) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def value_schema(struct: T.StructType) -> str:
    return _dumps(_struct_schema(struct, VALUE_NAME))


def key_schema(row: T.StructType, keys: Sequence[str]) -> str:
    fields = []
    for name in keys:
        if name not in row.fieldNames():
            raise ValueError(f"key column is not in the changelog schema: {name}")
        fields.append({**_field_schema(row[name].dataType, False), "field": name})
    head = {"type": "struct", "name": KEY_NAME, "optional": False}
    return _dumps({**head, "fields": fields})


# --- payload half ------------------------------------------------------------


def _signed_bytes(hex32: Column) -> Column:
    """Drop sign bytes that the next byte already implies."""
    positive = F.regexp_replace(hex32, "^(?:00)+(?=[0-7])", "")
    negative = F.regexp_replace(hex32, "^(?:FF)+(?=[89A-F])", "")
    return F.base64(F.unhex(F.when(hex32.rlike("^[89A-F]"), negative).otherwise(positive)))


def decimal_to_base64(c: Column, dtype: T.DecimalType) -> Column:
    """Unscaled value as minimal big-endian two's complement, base64.

    Above 18 digits the value is cut into a signed high and an unsigned low
    64-bit half, so all 38 digits stay inside built-in expressions.
    """
    unscaled = F.replace(c.cast("string"), F.lit("."), F.lit(""))
    if dtype.precision <= 18:
        return _signed_bytes(F.lpad(F.hex(unscaled.cast("bigint")), 16, "0"))
    whole = unscaled.cast("decimal(38,0)")
    two_64 = F.expr(_TWO_64)
    rest = whole % two_64
    low = F.when(rest < 0, rest + two_64).otherwise(rest).cast("decimal(20,0)")
    high = F.call_function("div", whole, two_64) - F.when(rest < 0, 1).otherwise(0)
    two_32 = F.lit(4294967296).cast("decimal(20,0)")
    halves = [
        F.lpad(F.hex(high), 16, "0"),
        F.lpad(F.hex(F.call_function("div", low, two_32)), 8, "0"),
        F.lpad(F.hex((low % two_32).cast("bigint")), 8, "0"),
    ]
    return _signed_bytes(F.concat(*halves))


def base64_to_decimal(c: Column, dtype: T.DecimalType) -> Column:
    """The way back from :func:`decimal_to_base64`."""
    digits = F.hex(F.unbase64(c))
    # Hex digits from 8 on begin a negative number; they sort behind the others.
    ahead = F.when(F.substring(digits, 1, 1) >= "8", "F" * 32).otherwise("0" * 32)
    extended = F.concat(ahead, digits)

    def part(start: int, length: int, base: int) -> Column:
        return F.conv(F.substring(extended, start, length), 16, base).cast("decimal(20,0)")

    if dtype.precision <= 18:
        # One product of exact decimals: the number is computed once, and no text in between.
        step = F.lit(Decimal(1).scaleb(-dtype.scale)) if dtype.scale else F.lit(Decimal(1))
        return (part(-16, 16, -10) * step).cast(dtype)
    # Below zero, step toward zero first: the product stays within 38 digits.
    high, low, two_64 = part(-32, 16, -10), part(-16, 16, 10), F.expr(_TWO_64)
    step = F.when(high < 0, 1).otherwise(0)
    whole = ((high + step) * two_64 + (low - step * two_64)).cast("decimal(38,0)")
    if dtype.scale == 0:
        return whole.cast(dtype)

    def pointed(w: Column) -> Column:
        text = F.replace(w.cast("string"), F.lit("-"), F.lit(""))
        padded = F.lpad(text, F.greatest(F.length(text), F.lit(dtype.scale + 1)), F.lit("0"))
        point = F.length(padded) - dtype.scale
        return F.concat(
            F.when(w < 0, "-").otherwise(""),
            padded.substr(F.lit(1), point),
            F.lit("."),
            padded.substr(point + 1, F.lit(dtype.scale)),
        ).cast(dtype)

    # The number is read several times below, so it is bound first.
    return F.when(c.isNotNull(), F.get(F.transform(F.array(whole), pointed), F.lit(0)))


def payload_column(c: Column, dtype: T.DataType) -> Column:
    """A column in the form it has inside a payload."""
    if isinstance(dtype, T.StructType):
        fields = [payload_column(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.DecimalType):
        return decimal_to_base64(c, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_millis(c)
    _field_schema(dtype, True)
    return c


_JSON_OPTIONS = {"ignoreNullFields": "false"}


def connect_payload(struct: T.StructType) -> Column:
    """Payload text of a whole row, every field written, nulls explicit."""
    fields = [payload_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in struct.fields]
    return F.to_json(F.struct(*fields), _JSON_OPTIONS)


def _message(schema: str, payload: Column) -> Column:
    return F.concat(F.lit('{"schema":' + schema + ',"payload":'), payload, F.lit("}"))


def connect_value(struct: T.StructType) -> Column:
    return _message(value_schema(struct), connect_payload(struct))


def image_type(struct: T.StructType) -> T.StructType | None:
    for name in ("after", "before"):
        if name in struct.fieldNames():
            return struct[name].dataType
    return None


def key_image(struct: T.StructType) -> Column:
    """The image a key is taken from: ``after`` when present, else ``before``."""
    present = [F.col(n) for n in ("after", "before") if n in struct.fieldNames()]
    return F.coalesce(*present) if present else F.lit(None)


def connect_key(struct: T.StructType, keys: Sequence[str]) -> Column:
    """Key message, null when a row has neither image."""
    row = image_type(struct)
    if row is None:
        return F.lit(None).cast("string")
    schema = key_schema(row, keys)
    image = key_image(struct)
    fields = [payload_column(image[k], row[k].dataType).alias(k) for k in keys]
    return F.when(image.isNotNull(), _message(schema, F.to_json(F.struct(*fields), _JSON_OPTIONS)))


# --- reading -----------------------------------------------------------------


def wire_type(dtype: T.DataType) -> T.DataType:
    """The JSON type under which a column type arrives."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, wire_type(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, (T.DecimalType, T.BinaryType)):
        return T.StringType()
    if isinstance(dtype, T.DateType):
        return T.IntegerType()
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return T.LongType()
    return dtype


def from_wire(c: Column, dtype: T.DataType) -> Column:
    """Column of its declared type from its JSON form."""
    if isinstance(dtype, T.StructType):
        fields = [from_wire(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.DecimalType):
        return base64_to_decimal(c, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(c)
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_millis(c)
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return F.timestamp_add("MICROSECOND", c * 1000, epoch)
    return c
