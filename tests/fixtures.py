"""Small inputs with known outcomes."""

from pyspark.sql import Row, types as T

from tidemark.model import SOURCE, SOURCE_CORE, envelope

T0 = 1_753_305_600_000

ROW = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("AMOUNT", T.StringType()),
        T.StructField("STATUS", T.StringType()),
    ]
)


def source(scn, tx=None, ts_ms=T0, schema="CDC", table="ORDERS"):
    return Row(scn=str(scn) if scn is not None else None, txId=tx, ts_ms=ts_ms, schema=schema, table=table)


def event(op, scn, before=None, after=None, tx=None, ts_ms=T0, table="ORDERS"):
    return (op, before, after, source(scn, tx, ts_ms, table=table), ts_ms)


def events(spark, rows, row=ROW):
    return spark.createDataFrame(rows, envelope(row, SOURCE_CORE))


#: Read, create, update, delete; what stays is row 2 as it was updated.
FOUR = [
    event("r", 1000, after=(1, "10.00", "OLD")),
    event("c", 1010, after=(2, "120.50", "NEW"), ts_ms=T0 + 1000),
    event("u", 1020, before=(2, "120.50", "NEW"), after=(2, "99.00", "PAID"), ts_ms=T0 + 2000),
    event("d", 1030, before=(1, "10.00", "OLD"), ts_ms=T0 + 3000),
]
FOUR_STATE = [(2, "99.00", "PAID")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


FULL_SOURCE = SOURCE
