"""Plain tables, and offsets of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(
    spark: SparkSession,
    source: str,
    name: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 200,
    **options: str,
) -> DataFrame:
    """A source or target table, from a folder of Parquet tables or over JDBC.

    A JDBC table is read in parallel ranges of ``partition_column``; bounds that
    miss rows do not lose them, they only make the outer ranges larger.
    """
    if not source.startswith("jdbc:"):
        return spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")
    return spark.read.format("jdbc").options(
        **jdbc_options(source, name, partition_column, bounds, partitions), **options
    ).load()


def jdbc_options(
    url: str,
    name: str,
    partition_column: str | None,
    bounds: tuple[int, int] | None,
    partitions: int,
) -> dict[str, str]:
    options = {"url": url, "dbtable": name, "fetchsize": "10000"}
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_offsets(documents: DataFrame, value: str = "offsets") -> DataFrame:
    """Offset per topic from ``{"topic": {"partition": offset}}`` documents.

    This is the form of ``endOffset`` and ``latestOffset`` in the progress of a
    streaming query. The partitions of a topic add up.
    """
    kept = [c for c in documents.columns if c != value]
    topics = documents.select(
        *kept, F.explode(F.from_json(value, "map<string, map<string, bigint>>")).alias("topic", "_p")
    )
    total = F.aggregate(F.map_values("_p"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return topics.select(*kept, "topic", total.alias("end_offset"))
