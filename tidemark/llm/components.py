"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stored


def _roots(parents: DataFrame) -> DataFrame:
    """(v, root) of a forest (v, parent) with parent < v, by pointer doubling."""
    known = stored(parents.select("v", F.col("parent").alias("root")), "roots")
    while True:
        up = known.select(F.col("v").alias("root"), F.col("root").alias("next"))
        jumped = stored(
            known.join(up, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        known = jumped.select("v", "root")
        if jumped.where("moved").isEmpty():
            return known


class Components:
    """The smallest vertex of each vertex's component, for edges (a, b).

    Each round every vertex with a smaller neighbour joins the smallest one, the
    trees are flattened by pointer doubling, and edges are contracted. Vertices
    with very many neighbours only meet partial sums and joins that Spark can split.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.rounds: list[DataFrame] = []
        edges = stored(self._ordered(edges), "edges")
        while not edges.isEmpty():
            parents = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent"))
            roots = _roots(parents)
            self.rounds.append(roots)
            for side in ("a", "b"):
                edges = self._moved(edges, side, roots)
            edges = stored(self._ordered(edges), "edges")

    @staticmethod
    def _ordered(edges: DataFrame) -> DataFrame:
        return (
            edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )

    @staticmethod
    def _moved(frame: DataFrame, column: str, roots: DataFrame) -> DataFrame:
        names = roots.select(F.col("v").alias(column), F.col("root").alias("__root"))
        return frame.join(names, column, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")

    def label(self, frame: DataFrame, column: str) -> DataFrame:
        """The frame with each vertex in ``column`` replaced by its component."""
        for roots in self.rounds:
            frame = self._moved(frame, column, roots)
        return frame
