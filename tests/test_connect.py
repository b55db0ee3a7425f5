import base64
import json
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from fixtures import FOUR, T0, event, events, rows
from tidemark.functions import connect as C
from tidemark.model import SOURCE_CORE, envelope
from tidemark.operators import replay
from tidemark.sources.envelopes import read_envelopes


def twos_complement(value: Decimal, scale: int) -> str:
    with localcontext() as ctx:
        ctx.prec = 80
        n = int(value.scaleb(scale))
    size = (n if n >= 0 else n + 1).bit_length() // 8 + 1
    return base64.b64encode(n.to_bytes(size, "big", signed=True)).decode()


def test_decimal_golden(spark):
    dtype = T.DecimalType(14, 2)
    golden = {"120.50": "LxI=", "0": "AA==", "-1.28": "gA==", "-1.29": "/38=", "1.28": "AIA=", "-0.01": "/w==", "-327.69": "/3//"}
    df = spark.createDataFrame([(k, Decimal(k)) for k in golden], T.StructType([T.StructField("k", T.StringType()), T.StructField("d", dtype)]))
    got = {r[0]: r[1] for r in df.select("k", C.decimal_to_base64(F.col("d"), dtype)).collect()}
    assert got == golden


@pytest.mark.parametrize("precision,scale", [(5, 0), (18, 4), (19, 2), (38, 0), (38, 10), (38, 37)])
@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_decimal_bytes_match_python_at_every_width(spark, precision, scale, data):
    top = 10**precision - 1
    edges = [0, 1, -1, top, -top, 127, 128, -128, -129, 2**31, -(2**31)]
    if precision > 19:
        edges += [2**63, -(2**63), 2**64, -(2**64), 2**64 - 1, -(2**64) - 1]
    ints = edges + data.draw(st.lists(st.integers(-top, top), max_size=60))
    with localcontext() as ctx:
        ctx.prec = 80
        values = [Decimal(i).scaleb(-scale) for i in ints if abs(i) <= top]
    dtype = T.DecimalType(precision, scale)
    df = spark.createDataFrame(
        [(v, twos_complement(v, scale)) for v in values],
        T.StructType([T.StructField("d", dtype), T.StructField("want", T.StringType())]),
    )
    coded = df.withColumn("b", C.decimal_to_base64(F.col("d"), dtype))
    wrong = coded.where((F.col("b") != F.col("want")) | ~C.base64_to_decimal(F.col("b"), dtype).eqNullSafe(F.col("d")))
    assert wrong.collect() == []


WIDE = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("B", T.BooleanType()),
        T.StructField("I", T.IntegerType()),
        T.StructField("F", T.DoubleType()),
        T.StructField("S", T.StringType()),
        T.StructField("X", T.BinaryType()),
        T.StructField("D", T.DecimalType(20, 3)),
        T.StructField("DAY", T.DateType()),
        T.StructField("AT", T.TimestampType()),
        T.StructField("AT_NTZ", T.TimestampNTZType()),
        T.StructField("IN", T.StructType([T.StructField("A", T.DecimalType(5, 2))])),
    ]
)


def test_schema_half():
    got = json.loads(C.value_schema(envelope(WIDE, SOURCE_CORE)))
    assert got["type"] == "struct" and got["name"] == "recovery.Envelope" and got["optional"]
    after = next(f for f in got["fields"] if f["field"] == "after")
    assert {f["field"]: f["type"] for f in after["fields"]} == {
        "ID": "int64", "B": "boolean", "I": "int32", "F": "double", "S": "string", "X": "bytes",
        "D": "bytes", "DAY": "int32", "AT": "int64", "AT_NTZ": "int64", "IN": "struct",
    }
    decimal = next(f for f in after["fields"] if f["field"] == "D")
    assert decimal == {
        "type": "bytes", "name": "org.apache.kafka.connect.data.Decimal", "version": 1,
        "parameters": {"scale": "3", "connect.decimal.precision": "20"}, "optional": True, "field": "D",
    }
    key = json.loads(C.key_schema(WIDE, ["ID"]))
    assert key["fields"] == [{"type": "int64", "optional": False, "field": "ID"}] and not key["optional"]


@pytest.mark.parametrize("ddl", ["array<int>", "map<string,int>", "interval day to second"])
def test_unsupported_types_are_refused(spark, ddl):
    with pytest.raises(C.UnsupportedType):
        C.value_schema(T.StructType.fromDDL(f"a {ddl}"))
    with pytest.raises(C.UnsupportedType):
        C.connect_payload(T.StructType.fromDDL(f"a {ddl}"))


def test_key_column_must_exist(spark):
    with pytest.raises(ValueError, match="NOPE"):
        C.connect_key(envelope(WIDE, SOURCE_CORE), ["NOPE"])


def test_key_from_after_then_before_else_none(spark):
    df = events(spark, [*FOUR, event("u", 1040)])
    got = df.select("source.scn", C.connect_key(df.schema, ["ID"])).collect()
    assert {r[0]: json.loads(r[1])["payload"] if r[1] else None for r in got} == {
        "1000": {"ID": 1}, "1010": {"ID": 2}, "1020": {"ID": 2}, "1030": {"ID": 1}, "1040": None,
    }
    assert tuple(replay.replay_counts(df).first()) == (4, 1)
    assert replay.messages(df, ["ID"]).count() == 4


def test_payload_writes_nulls(spark):
    df = events(spark, FOUR[:1])
    payload = json.loads(df.select(C.connect_payload(df.schema)).first()[0])
    assert payload["before"] is None and payload["source"]["txId"] is None
    assert payload["after"] == {"ID": 1, "AMOUNT": "10.00", "STATUS": "OLD"}


MS = st.integers(-(10**12), 4 * 10**12)
ROWS = st.tuples(
    st.integers(-(2**63), 2**63 - 1),
    st.none() | st.booleans(),
    st.none() | st.integers(-(2**31), 2**31 - 1),
    st.none() | st.floats(allow_nan=False, allow_infinity=False),
    st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=20),
    st.none() | st.binary(max_size=20).map(bytearray),
    st.none() | st.integers(-(10**20) + 1, 10**20 - 1).map(lambda i: Decimal(i) / 1000),
    st.none() | st.dates(date(1900, 1, 1), date(2100, 1, 1)),
    st.none() | MS.map(lambda m: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=m)),
    st.none() | MS.map(lambda m: datetime(1970, 1, 1) + timedelta(milliseconds=m)),
    st.none() | st.tuples(st.none() | st.integers(-99999, 99999).map(lambda i: Decimal(i) / 100)),
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(images=st.lists(ROWS, min_size=1, max_size=25))
def test_events_survive_the_wire(spark, images):
    """What is read back from the messages is what went in, for every type."""
    data = [event("u", i, before=None if i % 3 else img, after=img if i % 2 else None, ts_ms=T0 + i) for i, img in enumerate(images)]
    df = events(spark, data, WIDE)
    wire = df.select(C.connect_value(df.schema).alias("value"))
    back = read_envelopes(wire, WIDE, source=SOURCE_CORE)
    assert sorted(map(str, df.collect())) == sorted(map(str, back.select(*df.columns).collect()))


def test_bare_messages_tombstones_and_bad_json(spark):
    df = events(spark, FOUR)
    bare = df.select(C.connect_payload(df.schema).alias("value"))
    mixed = bare.union(spark.createDataFrame([(None,)], "value string"))
    row = df.schema["after"].dataType
    assert rows(read_envelopes(mixed, row, source=SOURCE_CORE).select("source.scn")) == [("1000",), ("1010",), ("1020",), ("1030",)]
    bad = mixed.union(spark.createDataFrame([("{not json",)], "value string"))
    with pytest.raises(Exception):
        read_envelopes(bad, row, source=SOURCE_CORE).collect()
    assert read_envelopes(bad, row, source=SOURCE_CORE, on_error="drop").count() == 4
