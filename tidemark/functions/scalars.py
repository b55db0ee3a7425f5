"""Names, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.model import DAY_MS, RECOVERY_PREFIX

Columnish = Column | str


def col(c: Columnish) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names -------------------------------------------------------------------


def table_suffix(schema: Columnish, table: Columnish) -> Column:
    return F.lower(F.concat_ws("_", col(schema), col(table)))


def changelog_name(schema: Columnish, table: Columnish, namespace: str = "changelog") -> Column:
    return F.concat(F.lit(namespace + "."), table_suffix(schema, table))


def topic_name(prefix: str, schema: Columnish, table: Columnish) -> Column:
    return F.concat_ws(".", F.lit(prefix), col(schema), col(table))


def recovery_topic(schema: Columnish, table: Columnish, prefix: str = RECOVERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix + "."), table_suffix(schema, table))


def upper_or_null(c: Columnish) -> Column:
    text = F.upper(F.trim(col(c)))
    return F.when(text != "", text)


# --- numbers -----------------------------------------------------------------


def strict_long(c: Columnish) -> Column:
    """Signed digits that fit 64 bits, else null. Blanks and decimals do not count."""
    text = col(c)
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def scn_long(c: Columnish = "source.scn") -> Column:
    return strict_long(c)


def truncate_ms(c: Columnish, width: int = DAY_MS) -> Column:
    """Floor to a multiple of ``width``, also below zero."""
    return col(c) - F.pmod(col(c), F.lit(width))


def mean_half_away(total: Column, count: Column) -> Column:
    """Integer mean, halves rounded away from zero, without leaving integers."""
    magnitude = F.call_function("div", F.abs(total) * 2 + count, count * 2)
    return F.when(total < 0, -magnitude).otherwise(magnitude)


# --- times -------------------------------------------------------------------

_EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def ntz_micros(c: Columnish) -> Column:
    """Microseconds since the epoch of a zone-less time.

    Built from its fields, which no session zone touches. A difference of
    timestamps would go through the session zone and move at its clock changes.
    """
    at = col(c)
    days = F.unix_date(at.cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(at)) * 3600 + F.minute(at) * 60
    micros = F.extract(F.lit("SECOND"), at) * F.lit(1_000_000).cast("decimal(7,0)")
    return seconds * 1_000_000 + micros.cast("bigint")


def ntz_millis(c: Columnish) -> Column:
    micros = ntz_micros(c)
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))


def millis_to_ntz(c: Columnish) -> Column:
    return F.timestamp_add("MICROSECOND", col(c) * 1000, F.expr(_EPOCH_NTZ))


def day_label(ms: Columnish) -> Column:
    """UTC ``yyyy-MM-dd`` of epoch millis."""
    days = F.call_function("div", truncate_ms(ms), F.lit(DAY_MS)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def truncate_time(grain: str, c: Columnish) -> Column:
    """Hour or day of a zone-less time, from its fields, so no zone rule can shift it."""
    day = col(c).cast("date").cast("timestamp_ntz")
    return {"DAY": day, "HOUR": F.timestamp_add("HOUR", F.hour(col(c)), day)}[grain.upper()]
