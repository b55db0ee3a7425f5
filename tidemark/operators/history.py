"""Earlier states from change rows: the state at a change number, row versions, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import HOT_ROWS, carried_forward, previous
from tidemark.operators.state import HIDDEN, ORDER, fold, live

#: Change numbers in one slice of a hot key.
SCN_WIDTH = 1_000_000


def state_as_of(rows: DataFrame, keys: Sequence[str], scn: int | Column) -> DataFrame:
    """What a reader of the table saw when change ``scn`` was the last one.

    Rows without a change number come before all others. The bound is a plain
    comparison, so it reaches the files' statistics.
    """
    return live(fold(rows.where((F.col("_scn") <= scn) | F.col("_scn").isNull()), keys))


def row_versions(
    rows: DataFrame, keys: Sequence[str], width: int = SCN_WIDTH, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every version of every row with the change numbers it was valid for: from ``valid_from`` on, before ``valid_to``.

    A delete ends a version and begins none; the last version has no
    ``valid_to``. A change that others of the same number overtake was never
    seen and has no version. Each row brings forth the version before it, and
    the fold of all changes the last one, so that hot keys can be cut into
    slices: no key is sorted in one piece.
    """
    image = [c for c in rows.columns if c not in (*HIDDEN, *keys)]
    before = {f"_was_{c}": c for c in [*image, "_scn", "_deleted"]}
    closed = previous(
        rows, keys, ORDER, before, F.col("_scn"), width, hot_rows, present="_has_previous"
    ).where(F.col("_has_previous") & ~F.col("_was__deleted") & ~F.col("_was__scn").eqNullSafe(F.col("_scn")))
    closed = closed.select(
        *keys, *[F.col(f"_was_{c}").alias(c) for c in image],
        F.col("_was__scn").alias("valid_from"), F.col("_scn").alias("valid_to"),
    )
    last = fold(rows, keys).where(~F.col("_deleted")).select(
        *keys, *image, F.col("_scn").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to")
    )
    return closed.unionByName(last)


def as_of_join(
    facts: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, width: int = SCN_WIDTH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each fact with the row of its key as it was at change number ``at``, nulls where there was none.

    ``facts`` has the key columns and ``at``. Facts and changes are ordered
    together once and the last change is carried forward to the facts behind it,
    so a key with many facts and many changes costs their sum and not their
    product; hot keys are cut into slices. Facts without ``at`` or with a null
    key find what changes without a number or with a null key left.
    """
    image = [c for c in rows.columns if c not in (*HIDDEN, *keys)]
    held = F.struct(F.struct(*image).alias("row"), F.col("_deleted").alias("gone"))
    marks = rows.select(*keys, F.col("_scn").alias("_at"), F.lit(0).alias("_kind"), *ORDER[1:], held.alias("_held"))
    others = [c for c in facts.columns if c not in keys]
    points = facts.select(
        *keys, F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*[F.col(c) for c in others]).alias("_fact"),
    )
    both = marks.unionByName(points, allowMissingColumns=True)
    found = carried_forward(
        both, keys, ["_at", "_kind", *ORDER[1:]], F.col("_held"), "_found", F.col("_at"), width, hot_rows
    ).where("_kind = 1")
    row = F.when(~F.col("_found.gone"), F.col("_found.row"))
    return found.select(
        *keys, *[F.col("_fact")[c].alias(c) for c in others], *[row[c].alias(c) for c in image]
    )
