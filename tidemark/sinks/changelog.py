"""Changelogs: append-only Parquet, one folder per source table, one partition per UTC day.

A changelog is the folder ``changelog_table=<schema>_<table>`` below a root, so one
write can route a mixed stream to many changelogs.

Events are stored as they are. Five columns stand beside the envelope:
``p_ts_ms`` (the day partition), ``scn_num`` (the change number as a number, so
that Parquet statistics can skip row groups), ``commit_id``, and ``commit_seq``
with ``ingest_seq``, the order in which events came in.

The declared schema lives in ``_schema/<n>.json`` and grows by addition. A scan
uses it directly instead of merging file footers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from tidemark.functions.scalars import day_label, scn_long, truncate_ms
from tidemark.model import CHANGELOG_SKELETON, DAY_MS
from tidemark.operators.routing import route
from tidemark.operators.state import with_ingest_order
from tidemark.sinks import files

_PREFIX = "changelog_table="

BESIDE = [
    T.StructField("scn_num", T.LongType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("commit_seq", T.LongType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("p_ts_ms", T.LongType()),
]


def table_path(root: str, schema: str, table: str) -> str:
    return f"{root.rstrip('/')}/{_PREFIX}{f'{schema}_{table}'.lower()}"


def _schema_dir(path: str) -> str:
    return f"{path}/_schema"


def read_schema(spark: SparkSession, path: str) -> T.StructType | None:
    versions = files.numbered(spark, _schema_dir(path))
    if not versions:
        return None
    text = files.read_text(spark, f"{_schema_dir(path)}/{versions[-1]}.json")
    return T.StructType.fromJson(json.loads(text))


def _write_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    versions = files.numbered(spark, _schema_dir(path))
    n = versions[-1] + 1 if versions else 0
    files.write_text(spark, f"{_schema_dir(path)}/{n}.json", schema.json())


def ensure_changelog(spark: SparkSession, root: str, schema: str, table: str) -> bool:
    """Create a changelog with the skeleton schema. False when it was there already."""
    path = table_path(root, schema, table)
    if files.exists(spark, _schema_dir(path)):
        return False
    _write_schema(spark, path, CHANGELOG_SKELETON)
    return True


def list_changelogs(spark: SparkSession, root: str) -> list[str]:
    """Names of the changelogs below a root, sorted; those of unregistered tables as well."""
    root = root.rstrip("/")
    names = [n for n in files.children(spark, root) if n.startswith(_PREFIX)]
    return [n[len(_PREFIX) :] for n in names if files.exists(spark, _schema_dir(f"{root}/{n}"))]


def evolve(current: T.StructType, incoming: T.StructType) -> T.StructType:
    """Add the incoming fields that are missing, at every depth. Types never change."""
    fields = []
    for field in current.fields:
        if field.name in incoming.fieldNames():
            new = incoming[field.name].dataType
            old = field.dataType
            if isinstance(old, T.StructType) and isinstance(new, T.StructType):
                field = T.StructField(field.name, evolve(old, new))
            elif old != new:
                raise ValueError(
                    f"column {field.name} changes type: {old.simpleString()} to {new.simpleString()}"
                )
        fields.append(T.StructField(field.name, field.dataType))
    known = {f.name for f in fields}
    fields += [T.StructField(f.name, f.dataType) for f in incoming.fields if f.name not in known]
    return T.StructType(fields)


def with_storage_columns(
    events: DataFrame, commit_id: str, commit_seq: int | None = None, seq: str | None = None
) -> DataFrame:
    """Events with the columns that stand beside them; commits are numbered by time if not told."""
    if commit_seq is None:
        commit_seq = time.time_ns() // 1_000
    return with_ingest_order(events, commit_seq, seq).withColumns(
        {
            "scn_num": scn_long("source.scn"),
            "commit_id": F.lit(commit_id),
            "p_ts_ms": truncate_ms("source.ts_ms"),
        }
    )


def _declare(spark: SparkSession, path: str, incoming: T.StructType) -> None:
    declared = read_schema(spark, path)
    grown = evolve(declared or CHANGELOG_SKELETON, incoming)
    if grown != declared:
        _write_schema(spark, path, grown)


def append_changelog(
    events: DataFrame,
    path: str,
    commit_id: str,
    cluster: bool = True,
    commit_seq: int | None = None,
    seq: str | None = None,
) -> None:
    """Append events to one changelog, growing its schema first when needed.

    ``cluster`` range-partitions by day and change number. Files then cover
    narrow change-number ranges, a day of any size is spread over many tasks,
    and no task writes to every day. Small streaming batches pass ``False`` and
    leave file sizing to a rebalance. The order inside a transaction is that of
    the column ``seq``, which is not stored otherwise, else that of the rows.
    """
    _declare(events.sparkSession, path, events.drop(seq or "").schema)
    rows = with_storage_columns(events, commit_id, commit_seq, seq).drop(seq or "")
    if cluster:
        rows = rows.repartitionByRange("p_ts_ms", "scn_num").sortWithinPartitions(
            "p_ts_ms", "scn_num"
        )
    else:
        rows = rows.hint("rebalance", "p_ts_ms")
    # Behind the exchange: sampling for the ranges must not count.
    counts = Observation()
    number = F.col("scn_num")
    rows = rows.observe(
        counts, F.count(F.lit(1)).alias("records"), F.min(number).alias("min_scn"), F.max(number).alias("max_scn")
    )
    rows.write.partitionBy("p_ts_ms").mode("append").parquet(path)
    _record_commit(events.sparkSession, path, {"commit_id": commit_id, "committed_ms": time.time_ns() // 1_000_000, **counts.get})


def append_routed(
    events: DataFrame,
    registry: DataFrame,
    root: str,
    commit_id: str,
    row_types: Mapping[tuple[str, str], T.StructType] | None = None,
    commit_seq: int | None = None,
    seq: str | None = None,
) -> None:
    """Append a mixed stream of events, each to the changelog of its table.

    Events of unregistered tables are left out. ``row_types`` gives the image
    columns of single tables; images in a mixed stream have the columns of all.
    One write serves all changelogs; the rebalance splits a table or day that
    dominates and merges small ones.
    """
    spark = events.sparkSession
    shape = events.drop(seq or "").schema
    tables = registry.select("schema_name", "table_name").distinct()
    for t in tables.toLocalIterator():
        own = (row_types or {}).get((t["schema_name"], t["table_name"]))
        _declare(spark, table_path(root, t["schema_name"], t["table_name"]), _with_images(shape, own))
    rows = with_storage_columns(events, commit_id, commit_seq, seq).drop(seq or "")
    rows = route(rows, registry).withColumn(
        "changelog_table", F.substring_index("changelog_table", ".", -1)
    )
    rows.hint("rebalance", "changelog_table", "p_ts_ms").write.partitionBy(
        "changelog_table", "p_ts_ms"
    ).mode("append").parquet(root)


def _with_images(shape: T.StructType, row: T.StructType | None) -> T.StructType:
    """An event's fields with images of another row type."""
    if row is None:
        return shape
    images = ("before", "after")
    return T.StructType([T.StructField(f.name, row if f.name in images else f.dataType) for f in shape.fields])


def scan_changelog(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """The whole changelog, or the days from the one holding ``since_ms`` on."""
    schema = read_schema(spark, path)
    if schema is None:
        raise FileNotFoundError(f"no changelog at {path}")
    full = T.StructType(schema.fields + BESIDE)
    has_data = any(n.startswith("p_ts_ms=") for n in files.children(spark, path))
    if not has_data:
        return spark.createDataFrame([], full)
    df = spark.read.schema(full).parquet(path)
    if since_ms is not None:
        day = since_ms - since_ms % DAY_MS
        df = df.where((F.col("p_ts_ms") >= day) | F.col("p_ts_ms").isNull())
    return df


# --- commits -------------------------------------------------------------------

_COMMIT = T.StructType(
    [T.StructField("commit_id", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("committed_ms", "records", "min_scn", "max_scn")]
)

#: Commit files before they are put into one.
_COMMIT_FILES = 64


def _record_commit(spark: SparkSession, path: str, commit: dict) -> None:
    """Note a commit beside the data; now and then all notes are put into one file.

    Each note carries the number it was first written under, so one that is in
    two files, because the second could not be removed, counts once.
    """
    folder = f"{path}/_commits"
    versions = files.numbered(spark, folder)
    n = versions[-1] + 1 if versions else 0
    lines = [json.dumps({"n": n, **commit})]
    merged = versions if len(versions) >= _COMMIT_FILES else []
    lines += [line for v in merged for line in files.read_text(spark, f"{folder}/{v}.json").splitlines()]
    files.write_text(spark, f"{folder}/{n}.json", "\n".join(lines))
    for v in merged:
        files.remove(spark, f"{folder}/{v}.json")


def changelog_commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a changelog with their records and change numbers, counted while they were written."""
    names = files.numbered(spark, f"{path}/_commits")
    schema = T.StructType([T.StructField("n", T.LongType()), *_COMMIT.fields])
    if not names:
        return spark.createDataFrame([], _COMMIT)
    rows = spark.read.schema(schema).json([f"{path}/_commits/{n}.json" for n in names])
    return rows.dropDuplicates(["n"]).drop("n")


def changelog_report(spark: SparkSession, path: str) -> DataFrame:
    """Records, files, bytes, commits and last commit of a changelog, without a look at its data.

    Commits that were written while counting was lost (a writer that stopped
    between its data and its note) are in files and bytes only.
    """
    days = [d for d in files.children(spark, path) if d.startswith("p_ts_ms=")]
    sizes = [size for d in days for size in files.listing(spark, f"{path}/{d}").values()]
    return changelog_commits(spark, path).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.lit(len(sizes)).cast("bigint").alias("files"),
        F.lit(sum(sizes)).cast("bigint").alias("bytes"),
        F.count_distinct("commit_id").alias("commits"),
        F.timestamp_millis(F.max("committed_ms")).alias("last_commit_at"),
    )


# --- small files ----------------------------------------------------------------

FILE_BYTES = 128 << 20


def compact_changelog(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES, least: int = 2) -> list[str]:
    """Put the small files of each day into files of about ``file_bytes``, by change number.

    Files of half that size or more stay. New files are written aside, noted,
    moved into the day, and then the old ones go: a reader in between sees some
    events twice, which every reader of a changelog folds away, and none is ever
    missing. A run that was broken off is ended by the next one. Each output
    file covers a narrow range of change numbers, so replays go on skipping.
    """
    _end_compactions(spark, path)
    done = []
    schema = read_schema(spark, path)
    for day in files.children(spark, path):
        if not day.startswith("p_ts_ms="):
            continue
        small = {n: size for n, size in files.listing(spark, f"{path}/{day}").items() if size < file_bytes // 2}
        if len(small) < least:
            continue
        parts = -(-sum(small.values()) // file_bytes)
        if parts >= len(small):
            continue
        fields = [*schema.fields, *(f for f in BESIDE if f.name != "p_ts_ms")]
        rows = spark.read.schema(T.StructType(fields)).parquet(*[f"{path}/{day}/{n}" for n in small])
        order = ["scn_num", "commit_seq", "ingest_seq"]
        packed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        packed.write.mode("overwrite").parquet(f"{path}/_packed/{day}")
        files.write_text(spark, f"{path}/_packed/{day}.json", json.dumps(sorted(small)))
        _end_compactions(spark, path)
        done.append(day)
    return done


def _end_compactions(spark: SparkSession, path: str) -> None:
    """Move what has been packed into its day and drop the files it replaces; without a note nothing counts."""
    names = files.children(spark, f"{path}/_packed")
    for note in (n for n in names if n.endswith(".json")):
        day = note.removesuffix(".json")
        for name in files.listing(spark, f"{path}/_packed/{day}"):
            files.rename(spark, f"{path}/_packed/{day}/{name}", f"{path}/{day}/{name}")
        for old in json.loads(files.read_text(spark, f"{path}/_packed/{note}")):
            files.remove(spark, f"{path}/{day}/{old}")
        files.remove(spark, f"{path}/_packed/{note}")
    files.remove(spark, f"{path}/_packed")


def drop_changelog(spark: SparkSession, path: str, purge: bool = False) -> None:
    """Forget a changelog; ``purge`` deletes its data as well."""
    files.remove(spark, path if purge else _schema_dir(path))


def expire_changelog(spark: SparkSession, path: str, cutoff_ms: int) -> list[int]:
    """Drop the day partitions that end at or before ``cutoff_ms``."""
    dropped = []
    for name in files.children(spark, path):
        value = name.removeprefix("p_ts_ms=")
        if name.startswith("p_ts_ms=") and value.lstrip("-").isdigit():
            day = int(value)
            if day + DAY_MS <= cutoff_ms:
                files.remove(spark, f"{path}/{name}")
                dropped.append(day)
    return dropped


# --- contents ----------------------------------------------------------------


def scan_contents(spark: SparkSession, root: str) -> DataFrame:
    """What the content reports need of all changelogs below a root, in one scan."""
    columns = [f for f in BESIDE if f.name in ("commit_id", "p_ts_ms")]
    schema = T.StructType(columns + [T.StructField("changelog_table", T.StringType())])
    return spark.read.schema(schema).parquet(root)


def data_files(changelog: DataFrame, by_commit: bool = True) -> DataFrame:
    """One row per data file, and commit in it, with its record count; without commits no column is read."""
    table = ["changelog_table"] if "changelog_table" in changelog.columns else []
    commit = ["commit_id"] if by_commit else []
    return (
        changelog.select(
            *table,
            "p_ts_ms",
            *commit,
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_bytes"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
        .groupBy(*table, "p_ts_ms", "file_path", "file_bytes", "modified_at", *commit)
        .agg(F.count(F.lit(1)).alias("records"))
    )


def changelog_partitions(changelog: DataFrame) -> DataFrame:
    """Records, files and bytes per day, by day; rows without a day form one bucket."""
    table = ["changelog_table"] if "changelog_table" in changelog.columns else []
    return (
        data_files(changelog, by_commit=False)
        .groupBy(*table, F.coalesce(day_label("p_ts_ms"), F.lit("(unpartitioned)")).alias("day"))
        .agg(
            F.sum("records").alias("records"),
            F.count(F.lit(1)).alias("files"),
            F.sum("file_bytes").alias("bytes"),
        )
        .orderBy(*table, "day")
    )


def changelog_summary(changelog: DataFrame) -> DataFrame:
    """Totals of one changelog in one row, or of each changelog of a root by name."""
    table = ["changelog_table"] if "changelog_table" in changelog.columns else []
    # A file may hold several commits once it has been packed; its bytes count once.
    first = F.row_number().over(Window.partitionBy(*table, "file_path").orderBy("commit_id")) == 1
    per_commit = data_files(changelog).withColumn("_first", first).groupBy(*table, "commit_id").agg(
        F.sum("records").alias("r"),
        F.count_if("_first").alias("f"),
        F.sum(F.when(F.col("_first"), F.col("file_bytes"))).alias("b"),
        F.max("modified_at").alias("m"),
    )
    totals = per_commit.groupBy(*table).agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("commits"),
        F.max("m").alias("last_commit_at"),
    )
    return totals.orderBy(*table) if table else totals
