"""Joins of many rows against a small relation such as the registry.

A plain equi join: the optimizer broadcasts the small side as far as its size
allows, by statistics or at run time, and splits skewed partitions otherwise.
Few distinct keys on the large side are the worst case of a shuffle join, so a
caller whose small side is too large to broadcast can ask for salts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def lookup(
    rows: DataFrame,
    small: DataFrame,
    on: Mapping[str, Column],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Join ``rows`` with ``small`` where each column of ``on`` equals its expression.

    The columns of ``small`` must have names that ``rows`` does not have.
    ``spread`` names columns of ``rows`` that differ within one key. With
    ``salts`` over 1 the rows of a key are dealt to that many tasks, and
    ``small`` is repeated as often.
    """
    pairs = [expr == F.col(name) for name, expr in on.items()]
    if salts == 1:
        return rows.join(small, reduce(lambda a, b: a & b, pairs), how)
    salted = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    pairs.append(F.col("_salt") == F.col("_copy"))
    return rows.join(salted, reduce(lambda a, b: a & b, pairs), how).drop("_salt", "_copy")
