"""Current state from change events, and merging new changes into a state.

A state row is the row image plus ``_scn, _tx, _seq, _tie, _deleted``. Deleted keys
stay as tombstones, so a change that arrives late or twice can never bring an
old image back: of two rows with one key the later in (scn, tx, seq, tie) wins,
whatever the arrival order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.scalars import scn_long
from tidemark.model import DELETE
from tidemark.operators.ordered import latest

ORDER = ["_scn", "_tx", "_seq", "_tie"]
HIDDEN = ORDER + ["_deleted"]

#: Per column the order of the change its value is from; null where that is the row's own order.
COLUMN_ORDER = "_column_order"


def newest_first() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in ORDER]


def change_rows(events: DataFrame, seq: str | None = None) -> DataFrame:
    """One flat row per event: the image columns and the order columns.

    Rows take their image from ``after``, on deletes from ``before``. Events
    with neither cannot name a key and are left out. Inside one transaction the
    order of arrival counts: the column ``seq`` if given, else commit and place
    within it as a changelog or a stream stores them (see ``with_ingest_order``).
    Events that carry neither are ordered by event time, then by a hash.
    """
    image = F.coalesce("after", "before")
    columns = events.schema["after"].dataType.fieldNames()
    if seq:
        place, tie = F.lit(0).cast("bigint"), F.col(seq).cast("bigint")
    elif {"commit_seq", "ingest_seq"} <= set(events.columns):
        place, tie = F.col("commit_seq"), F.col("ingest_seq")
    else:
        place, tie = F.col("ts_ms"), F.xxhash64("op", "before", "after")
    scn = F.col("scn_num") if "scn_num" in events.columns else scn_long("source.scn")
    return (
        events.where(F.col("after").isNotNull() | F.col("before").isNotNull())
        .select(
            image.alias("_image"),
            scn.alias("_scn"),
            F.coalesce(F.col("source.txId"), F.lit("")).alias("_tx"),
            place.alias("_seq"),
            tie.alias("_tie"),
            (F.col("op") == DELETE).alias("_deleted"),
        )
        .select(*[F.col("_image")[c].alias(c) for c in columns], *HIDDEN)
    )


def with_ingest_order(events: DataFrame, commit_seq: int, seq: str | None = None) -> DataFrame:
    """Events with ``commit_seq`` and ``ingest_seq``, their place in the order of arrival.

    The place is the column ``seq``, such as a message offset, then the commits
    need no order among them; else the position in the batch.
    """
    if seq:
        commit_seq, place = 0, F.col(seq).cast("bigint")
    else:
        place = F.monotonically_increasing_id()
    return events.withColumns({"commit_seq": F.lit(commit_seq).cast("bigint"), "ingest_seq": place})


def fold(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last row per key, tombstones included."""
    return latest(rows, keys, newest_first())


def live(state: DataFrame) -> DataFrame:
    """What a reader of the target table sees."""
    return state.where(~F.col("_deleted")).drop(*HIDDEN, COLUMN_ORDER)


def current_state(events: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    return live(fold(change_rows(events, seq), keys))


def own_order() -> Column:
    return F.struct(*ORDER)


def carrying(rows: DataFrame, columns: Mapping[str, T.DataType], keys: Sequence[str]) -> DataFrame:
    """Change rows that lack some of ``columns``, with nulls there and marked as not carrying them.

    A delete carries every column: it sets them to null.
    """
    order_type = rows.select(own_order().alias("o")).schema["o"].dataType
    names = [c for c in columns if c not in keys]
    orders = F.create_map(*(
        x for c in names
        for x in (F.lit(c), own_order() if c in rows.columns else F.lit(None).cast(order_type))
    ))
    values = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return rows.select(*values, *HIDDEN, F.when(~F.col("_deleted"), orders).alias(COLUMN_ORDER))


def fold_columns(rows: DataFrame, keys: Sequence[str], groups: Sequence[Sequence[str]]) -> DataFrame:
    """The state of each key when changes do not carry all columns.

    A column has the value of the last change that carries it; a delete carries
    all, as nulls. ``groups`` are the columns that are always carried together
    (without keys): one order decides for a group. The order is a maximum per
    group, taken on the map side first, so neither the sequence of arrival nor a
    hot key matters.
    """
    def order_of(group: Sequence[str]) -> Column:
        return F.when(F.col(COLUMN_ORDER).isNull(), own_order()).otherwise(F.col(COLUMN_ORDER)[group[0]])

    picked = [
        part for i, group in enumerate(groups) for part in (
            F.max_by(F.when(~F.col("_deleted"), F.struct(*group)), order_of(group)).alias(f"_values{i}"),
            F.max(order_of(group)).alias(f"_at{i}"),
        )
    ]
    last = rows.groupBy(*keys).agg(
        *picked, F.max(own_order()).alias("_last"), F.max_by("_deleted", own_order()).alias("_deleted")
    )
    as_row = reduce(lambda a, b: a & b, (F.col(f"_at{i}").eqNullSafe(F.col("_last")) for i in range(len(groups))), F.lit(True))
    orders = [x for i, group in enumerate(groups) for c in group for x in (F.lit(c), F.col(f"_at{i}"))]
    out = {c: F.col(f"_values{i}")[c] for i, group in enumerate(groups) for c in group}
    names = [c for c in rows.columns if c not in (*HIDDEN, COLUMN_ORDER)]
    return last.select(
        *(out[c].alias(c) if c in out else F.col(c) for c in names),
        *(F.col("_last")[c].alias(c) for c in ORDER), "_deleted",
        F.when(~as_row, F.create_map(*orders) if orders else None).cast(rows.schema[COLUMN_ORDER].dataType).alias(COLUMN_ORDER),
    )


def merge_batch(
    state: DataFrame, batch: DataFrame, keys: Sequence[str], small_batch: bool = True,
    groups: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """State after a batch of change rows. Applying a batch twice changes nothing.

    ``groups`` are the column groups of ``fold_columns`` if rows do not all
    carry all columns.

    With a batch that is small next to the state, only the state rows whose key
    occurs in it meet it in a fold. The others pass through an anti join, which
    needs no shuffle of the state while the batch keys can be broadcast. A batch
    of the state's own size is folded together with it, one shuffle for both.
    Both give the same rows; a null key is a key like any other.
    """
    def folded(rows: DataFrame) -> DataFrame:
        return fold(rows, keys) if groups is None else fold_columns(rows, keys, groups)

    if not small_batch:
        return folded(state.unionByName(batch.select(*state.columns)))
    new = folded(batch)
    named = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
    touched = state.join(named, same, "left_semi")
    untouched = state.join(named, same, "left_anti")
    merged = folded(touched.unionByName(new.select(*state.columns)))
    return untouched.unionByName(merged)


def expand_key_changes(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split updates that change the key into a delete of the old and a create of the new."""
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}"))
    moves = (F.col("op") == "u") & F.col("before").isNotNull() & F.col("after").isNotNull() & changed
    none = F.lit(None).cast(events.schema["after"].dataType)
    as_delete = F.struct(F.lit("d").alias("op"), F.col("before").alias("before"), none.alias("after"))
    as_create = F.struct(F.lit("c").alias("op"), none.alias("before"), F.col("after").alias("after"))
    as_is = F.struct(F.col("op"), F.col("before"), F.col("after"))
    parts = F.explode(F.when(moves, F.array(as_delete, as_create)).otherwise(F.array(as_is)))
    rest = [c for c in events.columns if c not in ("op", "before", "after")]
    return events.select(*rest, parts.alias("_p")).select("_p.op", "_p.before", "_p.after", *rest)
