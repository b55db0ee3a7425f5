"""Importance resampling towards a target: hashed n-gram weights, ranks by parallel sorting."""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import LOWER_BYTES, annotate, map_arrow, pieces, stored, utf8, word_bounds

#: Rows of a sorted segment, and samples drawn for each segment.
SEGMENT_ROWS = 1 << 20
SAMPLES = 64

#: Longer features are hashed one by one.
_SHORT = 64

#: Bytes of words: all but 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F, after A-Z are lower-cased.
_INSIDE = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each of many slices: one table step for all of them at a time."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_SHORT, "left"))
    out = np.empty(len(begin), np.uint32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes())
    rest = order[long:]
    at, falling = begin[rest], -size[rest]
    crc = np.full(len(rest), 0xFFFFFFFF, np.uint32)
    for step in range(int(-falling[0]) if len(rest) else 0):
        n = int(np.searchsorted(falling, -step, "left"))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + step]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[rest] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text number and bucket of each feature: runs of up to ``longest`` words."""
    data = LOWER_BYTES[data]
    begin, end = word_bounds(data, offsets, _INSIDE[data])
    owner = np.searchsorted(offsets, begin, "right") - 1
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    owners, found = [owner], [crc32s(data, begin, end) % buckets]
    if longest > 1 and len(begin):
        # The words again, one space behind each, so that every run is one slice.
        size = end - begin + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        take = np.repeat(begin - start, size) + np.arange(int(size.sum()))
        line = data[np.minimum(take, len(data) - 1)]
        line[start + size - 1] = 32
        for n in range(2, longest + 1):
            first = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
            last = first + n - 1
            owners.append(owner[first])
            found.append(crc32s(line, start[first], start[last] + size[last] - 1) % buckets)
    return n_words, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                _, _, found = features(data[part[0] : part[-1]], part - part[0], longest, buckets)
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    parts = map_arrow(texts.select(F.col(f"`{text_col}`").cast("string")), run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, one added to each bucket, floored."""
    all_s, all_t = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([
        math.floor(1000 * math.log(((t + 1.0) * all_s) / ((s + 1.0) * all_t)))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def importance(
    docs: DataFrame, target: DataFrame, keep: list[str], longest: int = 1, buckets: int = 10_000,
    text_col: str = "text",
) -> DataFrame:
    """``keep`` with n_words, n_features and weight: the floored mean gain of a text's features, 0 without any."""
    gain = gains(
        bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, "text", longest, buckets)
    )

    def weigh(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = utf8(batch.column("__text"))
        counts: list[list] = [[], [], []]
        for a, b in pieces(offsets):
            part = offsets[a : b + 1]
            n_words, owner, found = features(data[part[0] : part[-1]], part - part[0], longest, buckets)
            n = np.bincount(owner, minlength=b - a)
            # Whole numbers below 2^53: exact as doubles.
            total = np.bincount(owner, weights=gain[found], minlength=b - a).astype(np.int64)
            for column, x in zip(counts, (n_words, n, total // np.maximum(n, 1)), strict=True):
                column.append(x)
        return [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)) for x in counts]

    rows = docs.withColumn("__text", F.col(f"`{text_col}`").cast("string"))
    return annotate(rows, weigh, "n_words long, n_features long, weight long", keep=keep)


def _sorted_runs(rows: DataFrame, id_col: str) -> DataFrame:
    """Each partition sorted by itself, best first, rows with their run and place in it; others behind."""
    sorted_rows = rows.sortWithinPartitions(
        F.desc("__takes_part"), F.desc("score"), F.asc(f"`{id_col}`")
    ).withColumn("__run", F.spark_partition_id())
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("__place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            place = pa.array(np.arange(done, done + batch.num_rows))
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, place], schema.names)

    return stored(map_arrow(sorted_rows, run, schema), "runs")


def best_ranked(rows: DataFrame, id_col: str, wanted: Callable[[int], int], segments: int | None = None) -> DataFrame:
    """The rows with rank: 1, 2, 3... by falling score and rising id for the best, null for others.

    ``rows`` has ``score`` and ``__takes_part``; ``wanted`` gives the number to
    rank from the number of rows that take part. Each partition is sorted by
    itself and sampled at regular distances. The distances follow from the
    number of rows, so a segment has 64 samples however many there are; runs
    begin at different places, else all runs would sample the same quantiles.
    Every 64th sample is a splitter. Runs are cut at the splitters, the segments
    that hold wanted rows are exchanged and merged, and the counts of all
    segments before a row's own, added to its place there, are its rank. Run
    and place break ties, so copies of one row spread over segments as well.

    The driver holds 64 samples for each segment of a million rows.
    """
    spark = rows.sparkSession
    runs = _sorted_runs(rows, id_col)
    part = runs.where("__takes_part")
    n = part.count()
    if segments is None:
        segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    step = max(1, n // (segments * SAMPLES))
    chosen = (F.col("__place") + F.col("__run") * 0x9E3779B1) % step == 0
    samples = part.where(chosen).select((-F.col("score")).alias("a"), F.col(f"`{id_col}`"), "__run", "__place").collect()
    splitters = sorted(map(tuple, samples))[SAMPLES::SAMPLES]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = (batch.column(c).to_pylist() for c in ("__takes_part", "score", id_col, "__run", "__place"))
        return [pa.array([
            bisect.bisect_right(splitters, (-score, *rest)) if takes else None
            for takes, score, *rest in zip(*columns, strict=True)
        ], pa.int32())]

    runs = stored(annotate(runs, cut, "__segment int"), "segments")
    counts = dict(runs.where("__segment IS NOT NULL").groupBy("__segment").count().collect())
    limit, before, offsets = wanted(n), 0, {}
    for segment in range(len(splitters) + 1):
        if before >= limit:
            break
        offsets[segment] = before
        before += counts.get(segment, 0)
    last = len(offsets) - 1

    schema = T.StructType([*runs.schema.fields, T.StructField("rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, done = -1, 0
        for batch in batches:
            own = batch.column("__segment").to_numpy()
            rank = np.empty(len(own), np.int64)
            starts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
            for a, b in itertools.pairwise([*starts, len(own)]):
                if own[a] != segment:
                    segment, done = int(own[a]), offsets[int(own[a])]
                rank[a:b] = np.arange(done + 1, done + b - a + 1)
                done += b - a
            ranks = pa.array(rank, mask=rank > limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, ranks], schema.names)

    inner = F.col("__segment") <= last
    merged = runs.where(inner).repartition(max(last + 1, 1), "__segment").sortWithinPartitions(
        "__segment", F.desc("score"), F.asc(f"`{id_col}`"), "__run", "__place"
    )
    rest = runs.where(~inner | F.col("__segment").isNull()).withColumn("rank", F.lit(None).cast("long"))
    out = map_arrow(merged, number, schema).unionByName(rest)
    return out.drop("__takes_part", "__run", "__place", "__segment")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000,
    min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None, segments: int | None = None,
) -> DataFrame:
    """``keep`` (default the id) with n_words, n_features, weight, score and rank.

    Words are runs of digits, a-z and characters above 0x7F after A-Z are
    lower-cased; features are all runs of 1 to ``longest`` words of a text, each
    counted in one of ``buckets`` by CRC-32. A bucket's gain compares its share
    in ``target`` (column text) with its share in ``docs``; a text weighs the
    floored mean gain of its features, 0 without any. The score adds Gumbel
    noise drawn from seed and id, so the highest scores are a draw without
    replacement by weight. Of the documents with ``min_words`` words or more,
    ``percent`` in a hundred get a rank, the number floored, ties to the smaller
    id; others have a null rank. Null texts have no words. A document without id
    has no score, takes no part and counts in the buckets only. Repeated rows are
    documents of their own; of an empty table the result is empty. An empty
    target makes all buckets alike there.

    The driver holds the counts of the buckets and samples as ``best_ranked`` says.
    """
    own = F.col(f"`{id_col}`").cast("string")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), own), 256), 1, 8), 16, 10).cast("long")
    kept = [id_col] if keep is None else keep
    new = ("n_words", "n_features", "weight", "score", "rank", "__h", "__takes_part")
    kept = [c for c in kept if c not in new]
    weighed = importance(docs.withColumn("__h", noise), target, [*kept, "__h"], longest, buckets, text_col)

    def add_noise(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(batch.column("weight").to_pylist(), batch.column("__h").to_pylist(), strict=True)
        return [pa.array([
            None if h is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for w, h in pairs
        ], pa.int64())]

    scored = annotate(weighed, add_noise, "score long", keep=[*kept, "n_words", "n_features", "weight"])
    takes_part = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    return best_ranked(
        scored.withColumn("__takes_part", takes_part), id_col, lambda n: n * percent // 100, segments
    )
