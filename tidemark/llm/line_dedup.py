"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import lower_ascii
from tidemark.session import shared_dir

#: The characters 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The line keys seen so far, as sorted runs that are merged level by level.

    A run is a Parquet table of 128-bit key hashes with the id of the first
    document, bucketed and sorted by hash, so that a new batch is anti-joined
    with every run without moving the run. Each batch adds one run of level 0;
    ``fanout`` runs of a level are merged into one of the next before the next
    batch, so there are at most ``fanout`` runs for each power of ``fanout``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_chars: int = 10,
                 fanout: int = 4) -> None:
        self.spark = spark
        self.folder = folder or shared_dir(spark, "line-runs")
        self.min_chars = min_chars
        self.fanout = fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The batch without lines seen before, here or in an earlier batch.

        A key (line without white space at its ends, A-Z lower-cased) of at least
        ``min_chars`` code points stays in the first document holding it: that of
        the earliest batch, within a batch that of the smallest id, with all its
        lines there. Returns the input columns with ``text_col`` replaced, and
        n_lines (before), n_dropped; columns of these two names are replaced.
        A null text is one empty line. Rows without an id keep all lines and hold
        none. Rows that share an id are one holder.
        """
        self._compact()
        rows = docs.drop("n_lines", "n_dropped")
        lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
        keys = (
            docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), lines.alias("lines"))
            .select("doc", "version", F.posexplode("lines").alias("place", "line"))
            .withColumn("key", line_key(F.col("line")))
            .where(F.char_length("key") >= self.min_chars)
            .select(
                F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(7), "key").alias("h2"),
                "doc", "version", "place",
            )
        )
        found = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        seen = F.lit(None)
        for k, (_, run) in enumerate(self.runs):
            found = found.join(run.withColumnRenamed("doc", f"seen_{k}"), ["h1", "h2"], "left")
            seen = F.coalesce(F.col(f"seen_{k}"), seen)
        table, path = self._write(
            found.select(
                "h1", "h2",
                F.coalesce(seen, "first").alias("doc"),
                seen.isNull().alias("fresh"),
                (seen.isNotNull() | (F.col("first") != F.col("last"))).alias("shared"),
            )
        )
        self.runs.append((0, table.where("fresh").select("h1", "h2", "doc")))
        # Read without bucketing: then both sides are shuffled and a hot line's partition can be split.
        plain = self.spark.read.schema(table.schema).parquet(path)
        shared = plain.where("shared").select("h1", "h2", F.col("doc").alias("keeper"))
        dropped = (
            keys.join(shared, ["h1", "h2"])
            .where("doc <> keeper")
            .groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version"))
            .agg(F.array_sort(F.collect_set("place")).alias("__places"))
        )
        joined = rows.join(
            dropped,
            (F.col(id_col) == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__version")),
            "left",
        ).withColumn("__lines", lines)
        return joined.select(
            *[_kept().alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns],
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_dropped"),
        )

    def _compact(self) -> None:
        level = 0
        while any(x >= level for x, _ in self.runs):
            full = [run for x, run in self.runs if x == level]
            if len(full) >= self.fanout:
                merged = reduce(DataFrame.union, full).repartition(self.buckets, "h1", "h2")
                self.runs = [x for x in self.runs if x[0] != level]
                self.runs.append((level + 1, self._write(merged)[0]))
            level += 1

    def _write(self, run: DataFrame) -> tuple[DataFrame, str]:
        """Store a run and read it again; the catalog entry only serves to keep the bucketing known."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        (
            run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", path).saveAsTable(name)
        )
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table, path


def _kept() -> Column:
    """``__lines`` without those at ``__places``: the stretches between the places, in linear time."""
    places = F.col("__places")
    count = F.size(places)

    def stretch(k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(places, k - 1))
        after = F.when(k == count, F.size("__lines")).otherwise(F.get(places, k))
        return F.slice("__lines", before + 2, after - before - 1)

    stretches = F.flatten(F.transform(F.sequence(F.lit(0), count), stretch))
    return F.array_join(F.when(places.isNull(), F.col("__lines")).otherwise(stretches), "\n")


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, id_col: str = "doc_id",
                text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """A whole table, fed to the runs in batches of ascending id: the smallest id keeps a line."""
    runs = LineRuns(docs.sparkSession, fanout=fanout, min_chars=min_chars)
    shares = [k / batches for k in range(1, batches)]
    edges = sorted(set(docs.approxQuantile(id_col, shares, 0.01))) if shares else []
    place = F.col(id_col)
    parts = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        inside = F.lit(True)
        if low is not None:
            inside &= (place > low) | place.isNull() if high is None else place > low
        if high is not None:
            inside &= place <= high
        parts.append(runs.add(docs.where(inside), id_col, text_col))
    return reduce(DataFrame.union, parts)
