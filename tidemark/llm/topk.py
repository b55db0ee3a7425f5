"""Exact search by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import ship, stored

#: Rows of a block of candidates and of a block of queries.
CANDIDATE_ROWS = 16_384
QUERY_ROWS = 1_024

#: Shares of the lists that are read before bounds are compared.
DEPTHS = (1 / 4, 1 / 2, 5 / 8, 3 / 4, 1.0)

#: Sums of products below this fit a 64-bit integer.
_LONG = 2.0**62


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or has a null or non-finite one."""
    value = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.when(~bad, value)


class SortedLists:
    """A block of vectors as one list for each component, sorted by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.order, 1).astype(np.float64)

    def top(self, query: np.ndarray, k: int, own: int) -> np.ndarray:
        """Places of the k vectors of the highest inner product, ties to the smaller id, without id ``own``.

        Each list is read from the end that adds most. A vector's lower bound
        takes the worst value of every list it has not appeared in, its upper
        bound the value last read there. Vectors whose upper bound is below the
        k-th lower bound cannot qualify; once few are left, or all lists are
        read, the scores of those left are resolved.
        """
        n = len(self.ids)
        alive = np.flatnonzero(self.ids != own)
        used = np.flatnonzero(query)
        weights = query[used].astype(np.float64)
        up = weights > 0
        worst = weights * np.where(up, self.values[used, 0], self.values[used, -1])
        # Bounds are doubles: what their sums may be off by grows with the products.
        terms = np.abs(weights) * np.maximum(np.abs(self.values[used, 0]), np.abs(self.values[used, -1]))
        slack = 0.5 + float(terms.sum()) * (len(used) + 8) * 2.0**-50
        partial, lower = np.zeros(n), np.full(n, worst.sum())
        seen = np.zeros((n, len(used)), order="F")
        done = 0
        for share in DEPTHS:
            if len(alive) <= max(64, 4 * k) or not len(used):
                break
            depth = max(done + 1, min(n, int(n * share)))
            frontier = np.empty(len(used))
            for j, d in enumerate(used):
                part = slice(n - depth, n - done) if up[j] else slice(done, depth)
                at, adds = self.order[d, part], weights[j] * self.values[d, part]
                partial[at] += adds
                lower[at] += adds - worst[j]
                seen[at, j] = 1
                frontier[j] = weights[j] * self.values[d, n - depth if up[j] else depth - 1]
            done = depth
            if len(alive) > k:
                upper = partial + (frontier.sum() - seen @ frontier)
                bar = np.partition(lower[alive], len(alive) - k)[len(alive) - k]
                alive = alive[upper[alive] >= bar - slack]
            if depth == n:
                break
        best = np.lexsort((self.ids[alive], -self.scores(alive, query)))[:k]
        return alive[best]

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; as Python integers where 64 bits might not do."""
        largest = float(np.abs(query.astype(np.float64)).max(initial=0)) * self.largest * max(len(query), 1)
        kind = np.int64 if largest < _LONG else object
        return self.vectors[at].astype(kind) @ query.astype(kind)


def _order(score: int) -> list[int]:
    """A score of any size as numbers that sort as it does."""
    low = (1 << 60) - 1
    return [score >> 120, score >> 60 & low, score & low]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id_col and score of the ``k`` best candidates of each query, or all if fewer.

    Vectors are arrays of long; a shorter one counts as padded with zeros. The
    score is the inner product, ties go to the smaller id; a query is no
    candidate of its own id. Rows without id or vector take no part, rows equal
    in id and vector count once. Queries and candidates are dealt to blocks by
    hash, each pair of blocks is searched in one task, and the best of all
    blocks are merged. Ranks are exact for components of any size; a score above
    the range of a long is given as its largest value (below: smallest).
    """
    ship(queries.sparkSession)
    id_type = candidates.schema[id_col].dataType

    def clean(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
            "id IS NOT NULL AND vector IS NOT NULL"
        ).distinct()

    asked, offered = stored(clean(queries), "queries"), stored(clean(candidates), "candidates")
    query_blocks = -(-asked.count() // QUERY_ROWS) or 1
    blocks = -(-offered.count() // CANDIDATE_ROWS) or 1

    def dealt(rows: DataFrame, own: int, own_name: str, other: int, other_name: str) -> DataFrame:
        return rows.select(
            "*",
            F.pmod(F.xxhash64("id", "vector"), F.lit(own)).cast("int").alias(own_name),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name),
        )

    schema = T.StructType([
        T.StructField("query_id", id_type), T.StructField(id_col, id_type), T.StructField("score", T.LongType()),
        T.StructField("__order", T.ArrayType(T.LongType())),
    ])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            width = max(
                int(np.diff(x["vector"].combine_chunks().offsets.to_numpy()).max()) for x in (left, right)
            )
            wanted, vectors = _matrix(left["vector"], width), _matrix(right["vector"], width)
            lists = SortedLists(right["id"].to_numpy(), vectors)
            for query_id, query in zip(left["id"].to_pylist(), wanted, strict=True):
                at = lists.top(query, k, query_id)
                scores = lists.scores(at, query).tolist()
                found[0] += [query_id] * len(at)
                found[1] += lists.ids[at].tolist()
                found[2] += [min(max(x, -(2**63)), 2**63 - 1) for x in scores]
                found[3] += map(_order, scores)
        types = (left["id"].type, left["id"].type, pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(x, y) for x, y in zip(found, types, strict=True)], names=schema.names)

    pairs = (
        dealt(asked, query_blocks, "q", blocks, "c").groupBy("q", "c")
        .cogroup(dealt(offered, blocks, "c", query_blocks, "q").groupBy("q", "c"))
        .applyInArrow(search, schema)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("__order"), id_col))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
