"""Side tables of the pipeline: metric samples, schema changes, the timeline."""

from __future__ import annotations

import logging
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.model import METRIC_SAMPLE
from tidemark.operators.metrics import KEEP_HOURS, SAMPLE_COLUMNS, rollup
from tidemark.sinks import files

log = logging.getLogger(__name__)


# --- metric samples: partitioned by resolution and day -------------------------


def append_samples(samples: DataFrame, path: str) -> None:
    """Append samples; the partitions carry what series and purges filter on."""
    day = F.col("sampled_at").cast("date").cast("string")
    rows = samples.select(*SAMPLE_COLUMNS).withColumn("p_day", day)
    rows.hint("rebalance", "resolution", "p_day").write.partitionBy("resolution", "p_day").mode(
        "append"
    ).parquet(path)


def read_samples(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Stored samples; with ``since``, a time without a zone, older days are not opened."""
    schema = T.StructType(METRIC_SAMPLE.fields + [T.StructField("p_day", T.StringType())])
    if not files.exists(spark, path):
        return spark.createDataFrame([], METRIC_SAMPLE)
    samples = spark.read.schema(schema).parquet(path)
    if since is not None:
        samples = samples.where(F.col("p_day") >= since.cast("date").cast("string"))
        samples = samples.where(F.col("sampled_at") >= since)
    return samples.select(*SAMPLE_COLUMNS)


def roll_store(spark: SparkSession, path: str, now: datetime) -> None:
    """The hourly roll-up: closed hours, then closed days, then the purge by age."""
    hour = now.replace(minute=0, second=0, microsecond=0)
    for grain, cutoff in (("HOUR", hour), ("DAY", hour.replace(hour=0))):
        rolled = rollup(read_samples(spark, path), grain, _ntz(cutoff))
        append_samples(rolled, path)
    purge_store(spark, path, now)


def _ntz(at: datetime):
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def purge_store(spark: SparkSession, path: str, now: datetime) -> list[str]:
    """Drop what is older than its resolution is kept.

    Whole days go as folders. Only the day the limit falls into is rewritten: next
    to the store, then the folders are swapped. A swap that was broken off is
    ended by the next purge, so at any time one full copy exists.
    """
    dropped = []
    _end_swaps(spark, path)
    for resolution, hours in KEEP_HOURS.items():
        limit = now - timedelta(hours=hours)
        edge = limit.strftime("%Y-%m-%d")
        folder = f"{path}/resolution={resolution}"
        for name in files.children(spark, folder):
            day = name.removeprefix("p_day=")
            if name.startswith("p_day=") and day < edge:
                files.remove(spark, f"{folder}/{name}")
                dropped.append(f"{resolution}/{day}")
        part = f"{folder}/p_day={edge}"
        if files.exists(spark, part):
            schema = T.StructType(
                [f for f in METRIC_SAMPLE.fields if f.name != "resolution"]
            )
            keep = spark.read.schema(schema).parquet(part).where(F.col("sampled_at") >= _ntz(limit))
            staged = f"{path}/_staged/resolution={resolution}/p_day={edge}"
            keep.write.mode("overwrite").parquet(staged)
            _swap(spark, staged, part)
    files.remove(spark, f"{path}/_staged")
    return dropped


def _swap(spark: SparkSession, staged: str, part: str) -> None:
    """Put a finished folder in place of another one."""
    files.remove(spark, part)
    files.rename(spark, staged, part)


def _end_swaps(spark: SparkSession, path: str) -> None:
    """Finished staged days whose place is empty move there; other staged data is dropped."""
    for resolution in files.children(spark, f"{path}/_staged"):
        for day in files.children(spark, f"{path}/_staged/{resolution}"):
            staged, part = f"{path}/_staged/{resolution}/{day}", f"{path}/{resolution}/{day}"
            if files.exists(spark, f"{staged}/_SUCCESS") and not files.exists(spark, part):
                files.rename(spark, staged, part)
    files.remove(spark, f"{path}/_staged")


# --- batch-keyed appends -------------------------------------------------------


def batches(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Finished batch folders in batch order, optionally only those before a batch.

    A merged folder stands for all batches up to its number.
    """
    found: dict[str, list[int]] = {"merged": [], "batch": []}
    for name in files.children(spark, path):
        kind, _, number = name.partition("=")
        if kind in found and number.isdigit() and files.exists(spark, f"{path}/{name}/_SUCCESS"):
            found[kind].append(int(number))
    first = max(found["merged"], default=None)
    numbers = sorted(n for n in found["batch"] if (first is None or n > first) and (before is None or n < before))
    merged = [] if first is None else [f"{path}/merged={first}"]
    return merged + [f"{path}/batch={n}" for n in numbers]


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    folders = batches(spark, path, before)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _numbered(spark: SparkSession, path: str, kind: str) -> list[int]:
    names = (name.partition("=") for name in files.children(spark, path))
    return sorted(int(n) for k, _, n in names if k == kind and n.isdigit())


def prune_batches(spark: SparkSession, path: str, batch_id: int, keep: int = 2) -> None:
    """Drop folders that newer ones replace: of states kept per batch only the last few are ever read.

    The one before ``batch_id`` stays, so that this batch can be taken again.
    """
    for n in _numbered(spark, path, "batch"):
        if n <= batch_id - keep:
            files.remove(spark, f"{path}/batch={n}")


def merge_batches(spark: SparkSession, path: str, schema: T.StructType, upto: int, most: int = 16) -> bool:
    """Put the rows of all batches up to a number into one folder, once there are more than ``most``.

    ``upto`` is a batch that will not be taken again. The merged folder counts
    once it is complete, and from then on the folders it stands for do not, so
    a job that stops in between loses and repeats nothing.
    """
    old = [n for n in _numbered(spark, path, "batch") if n <= upto]
    merged = _numbered(spark, path, "merged")
    folders = [f for f in batches(spark, path) if int(f.rsplit("=", 1)[1]) <= upto]
    done = bool(folders) and len(folders) > most
    if done:
        spark.read.schema(schema).parquet(*folders).coalesce(1 + len(folders) // 1000).write.mode("overwrite").parquet(
            f"{path}/merged={upto}"
        )
    current = max((n for n in _numbered(spark, path, "merged") if files.exists(spark, f"{path}/merged={n}/_SUCCESS")), default=-1)
    for n in old:
        if n <= current:
            files.remove(spark, f"{path}/batch={n}")
    for n in merged:
        if n < current:
            files.remove(spark, f"{path}/merged={n}")
    return done


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch under its id; a retry replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def record_events(events: DataFrame, path: str) -> bool:
    """Append timeline rows. A failure is logged and never reaches the caller."""
    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception as e:  # the timeline is a by-product of the caller's real work
        log.warning("timeline write failed: %s", e)
        return False
