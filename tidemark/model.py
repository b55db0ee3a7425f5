"""Row shapes shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_MS = 86_400_000

# Name prefixes of recovery topics and of the sinks of single tables.
RECOVERY_PREFIX = "dz-recovery"
SINK_PREFIX = "dz-jdbc-sink-"

# Operation codes of a change event.
CREATE, UPDATE, DELETE, SNAPSHOT_READ = "c", "u", "d", "r"

#: Provenance block of a change event. ``scn`` stays text: it is the wire form.
SOURCE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("connector", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("db", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("txId", T.StringType()),
        T.StructField("scn", T.StringType()),
        T.StructField("commit_scn", T.StringType()),
    ]
)

#: The part of the source block a changelog is created with.
SOURCE_CORE = T.StructType(
    [SOURCE[name] for name in ("scn", "txId", "ts_ms", "schema", "table")]
)

#: A changelog before its first record; images are added by evolution.
CHANGELOG_SKELETON = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("source", SOURCE_CORE),
    ]
)


def envelope(row: T.StructType, source: T.StructType = SOURCE) -> T.StructType:
    """Change event carrying images of the given row type."""
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", row),
            T.StructField("after", row),
            T.StructField("source", source),
            T.StructField("ts_ms", T.LongType()),
        ]
    )


METRIC_SAMPLE = T.StructType(
    [
        T.StructField("sampled_at", T.TimestampNTZType()),
        T.StructField("metric", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("sample_value", T.LongType()),
        T.StructField("sample_value2", T.LongType()),
        T.StructField("resolution", T.StringType()),
    ]
)

DDL_EVENT = T.StructType(
    [
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("event_ts_ms", T.LongType()),
        T.StructField("scn", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("ddl_text", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

TABLE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_at", T.TimestampNTZType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

#: One connector's status as reported by the replication runtime.
CONNECTOR_STATUS = T.StructType(
    [
        T.StructField(
            "connector",
            T.StructType(
                [T.StructField("state", T.StringType()), T.StructField("trace", T.StringType())]
            ),
        ),
        T.StructField(
            "tasks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("state", T.StringType()),
                        T.StructField("trace", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
