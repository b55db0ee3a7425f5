"""The corpus pipeline: from raw documents to token ids of clean, distinct ones.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. Documents with null or empty texts, repeated rows and further columns go
through as the operators define it; an empty table stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language
from tidemark.llm.frames import stored
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.tiling import drop_leaks


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null or have no letter go, these alone if no language is known."""
    trees = language.train(docs)
    if not trees.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, trees)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of ten characters or more only in the first document that holds it; n_chars follows."""
    kept = dedup_lines(docs)
    return kept.select(*(
        F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, and of rows of one id the first by text hash.

    Rows are told apart by id and text, so a row stays if only another one of
    its id has a copy, and of rows equal in both one stays. Rows without an id
    and those without words are in no group and stay.
    """
    own = docs.withColumn("__own", F.xxhash64("text"))
    row = ["doc_id", "__own"]
    groups = stored(
        near_duplicates(own, keep=["__own"]).where("doc_id IS NOT NULL AND n_shingles > 0"), "groups"
    )
    first = groups.groupBy("component_id").agg(F.min(F.struct(*row)).alias("first")).select("first.*")
    several = groups.groupBy(*row).count().where("count > 1").select(*row)
    later = groups.select(*row).distinct().join(first, row, "left_anti")
    single = own.join(later.unionByName(several).distinct(), row, "left_anti")
    # Rows that occur more than once, as far as they come first in their group.
    again = own.join(several.join(first, row, "left_semi"), row, "left_semi").dropDuplicates(row)
    return single.unionByName(again).drop("__own")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in one piece or several."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their byte-level BPE ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, lasting=False)


STAGES = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: SQL cannot express language ID, decontamination or BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
