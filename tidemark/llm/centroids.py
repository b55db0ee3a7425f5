"""Clustering of integer vectors: Lloyd's rounds with the threshold algorithm inside.

The rows stay in Spark; each round's tasks send back only sums per cluster and
dimension. All arithmetic is in whole numbers, so results do not depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import annotate, map_arrow, stored

#: Below this, squared distances over 64 dimensions fit a 64-bit integer.
_SMALL = 1 << 27

#: Sums travel as digits of so many bits, so their size has no limit.
_DIGIT = 40

LONGEST = 2**63 - 1


class CentroidLists:
    """One sorted list of centroid values for each dimension."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance for each row; ties to the smaller number.

        Every list is walked outward from the row's own value, the nearer
        neighbour first. Each step gives the centroids it meets for the first
        time their exact distance. A centroid not met yet is at least as far as
        the sum of the squared gaps at the frontier, so a row is done once this
        sum is above its best distance; at equality a smaller number may follow.
        """
        k, width = self.centroids.shape
        n, dims = len(rows), np.arange(width)
        above = np.empty((n, width), np.int64)
        for d in range(width):
            above[:, d] = np.searchsorted(self.values[:, d], rows[:, d])
        below = above - 1
        best, number = np.zeros(n, rows.dtype), np.full(n, -1)
        seen = np.zeros((n, k), bool)
        active = np.arange(n)
        for _ in range(k):
            if not len(active):
                break
            own, low, high = rows[active], below[active], above[active]
            down = own - self.values[np.maximum(low, 0), dims]
            up = self.values[np.minimum(high, k - 1), dims] - own
            left = (high == k) | ((low >= 0) & (down <= up))
            met = self.order[np.where(left, low, high), dims]
            fresh = np.zeros((len(active), k), bool)
            fresh[np.arange(len(active))[:, None], met] = True
            fresh &= ~seen[active]
            seen[active] |= fresh
            for c in range(k):
                at = np.flatnonzero(fresh[:, c])
                far = ((own[at] - self.centroids[c]) ** 2).sum(axis=1)
                row = active[at]
                closer = (number[row] < 0) | (far < best[row]) | ((far == best[row]) & (c < number[row]))
                best[row[closer]], number[row[closer]] = far[closer], c
            frontier = (np.where(left, down, up) ** 2).sum(axis=1)
            below[active] -= left
            above[active] += ~left
            active = active[(frontier <= best[active]).astype(bool)]
        return number, best


def _whole(x: float) -> int:
    """floor(1024 * x); a number this large is whole already."""
    return int(x) * 1024 if abs(x) >= 2.0**53 else int(np.floor(1024 * x))


def _assigned(column: pa.Array, width: int, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the batch, whole vectors, centroid numbers and distances; large components as Python integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    plain = (np.abs(values) < _SMALL >> 10).all(axis=1)
    if any(abs(x) >= _SMALL for c in centroids for x in c) or width > 64:
        plain[:] = False
    for rows, dtype in ((np.flatnonzero(plain), np.int64), (np.flatnonzero(~plain), object)):
        if len(rows):
            part = values[rows]
            if dtype is object:
                whole = np.array([[_whole(x) for x in row] for row in part.tolist()], object).reshape(part.shape)
            else:
                whole = np.floor(part * 1024).astype(np.int64)
            yield rows, whole, *CentroidLists(np.array(centroids, dtype).reshape(-1, width)).nearest(whole)


def _sums(vectors: DataFrame, width: int, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), width + 1), object)
        for batch in batches:
            for _, rows, number, _ in _assigned(batch.column(0), width, centroids):
                for c in np.unique(number).tolist():
                    mine = rows[number == c]
                    totals[c] += np.array([*mine.sum(axis=0).tolist(), len(mine)], object)
        found: list[list[int]] = [[], [], [], []]
        for c, d in zip(*np.nonzero(totals), strict=True):
            rest, place = totals[c, d], 0
            while rest not in (0, -1) or place == 0:
                digit = rest & (1 << _DIGIT) - 1
                rest >>= _DIGIT
                if rest == -1:  # The topmost digit carries the sign.
                    digit, rest = digit - (1 << _DIGIT), 0
                for column, x in zip(found, (c, d, place, digit), strict=True):
                    column.append(int(x))
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["c", "d", "place", "digit"])

    parts = map_arrow(vectors, run, "c long, d long, place long, digit long")
    totals: dict[tuple[int, int], int] = defaultdict(int)
    for row in parts.groupBy("c", "d", "place").agg(F.sum("digit").alias("digit")).collect():
        totals[row.c, row.d] += row.digit << _DIGIT * row.place
    return [(totals[c, width], [totals[c, d] for d in range(width)]) for c in range(len(centroids))]


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The kept rows with cluster, distance, cluster_inertia, inertia and centroid (its components, comma-joined).

    Kept are vectors of exactly ``width`` components, none null, NaN or infinite;
    each component x counts as floor(1024 * x). The ``k`` vectors whose
    ``seed:id`` has the smallest SHA-256 are the first centroids (of one id the
    smaller vector first; rows without an id belong to clusters, but start
    none). Each round gives every vector to the nearest centroid, ties to the
    smaller number, and moves each non-empty centroid to the floored means; at
    the end vectors are given once more. With fewer than ``k`` kept vectors
    there are as many centroids; with none that has an id the result is empty.
    Repeated rows count as often as they occur. Components of any finite size
    are exact; distances and sums above the range of a long are given as its
    largest value. Input columns with the names of new ones are replaced.

    The driver holds ``k`` centroids, nothing that grows with the table.
    """
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    values = F.col(f"`{vector_col}`").cast("array<double>")
    kept = stored(vectors.drop(*added).where((F.size(values) == width) & F.forall(values, _finite)), "vectors")
    spark, names = kept.sparkSession, kept.columns

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256)
    first = kept.select(key.alias("key"), values.alias("vector")).where("key IS NOT NULL").orderBy("key", "vector").limit(k)
    centroids = [[_whole(x) for x in row[1]] for row in first.collect()]
    for _ in range(rounds if centroids else 0):
        moved = _sums(kept.select(values), width, centroids)
        centroids = [
            [x // n for x in total] if n else old for old, (n, total) in zip(centroids, moved, strict=True)
        ]

    def assign(batch: pa.RecordBatch) -> list[pa.Array]:
        cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
        for at, _, number, far in _assigned(batch.column("__vector"), width, centroids):
            cluster[at], distance[at] = number, np.minimum(far, LONGEST).astype(np.int64)
        return [pa.array(cluster), pa.array(distance)]

    if not centroids:
        kept = kept.limit(0)
    given = annotate(kept.withColumn("__vector", values), assign, "cluster int, distance long", keep=names)
    assigned = stored(given, "clusters")
    sums = {
        row[0]: int(row[1]) for row in
        assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    }
    total = min(sum(sums.values()), LONGEST)
    rows = [(c, min(sums.get(c, 0), LONGEST), total, ",".join(map(str, x))) for c, x in enumerate(centroids)]
    about = spark.createDataFrame(rows, T.StructType.fromDDL(
        "__c int, cluster_inertia long, inertia long, centroid string"
    ))
    # k rows, whatever the table.
    return assigned.join(F.broadcast(about), F.col("cluster") == F.col("__c")).drop("__c")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
