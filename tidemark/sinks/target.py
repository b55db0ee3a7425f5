"""Target tables: idempotent upserts and deletes on plain Parquet.

Parquet has no row-level update, so a target is a base version plus one small
delta per applied batch, each folded to one row per key. Reading merges the
two; compaction writes a new base. A batch is stored under its id, so applying
it again replaces the same folder. Deltas merge by change order and not by
arrival, so batches may come late, twice, or from a replay. Once a batch lacked
columns, values merge by the change order of each group of columns.

``_pointer/<n>.json`` says which generation, base and deltas are valid; the
highest number counts. A truncate starts a new generation, whose rows are never
compared with those of the old one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.state import COLUMN_ORDER, HIDDEN, ORDER, carrying, fold, fold_columns, live, merge_batch
from tidemark.sinks import files


#: Deltas below one part in this many of the base count as a small batch.
SMALL_SHARE = 10


def _order_type(schema: T.StructType) -> T.StructType:
    return T.StructType([schema[c] for c in ORDER])


class SchemaMismatch(ValueError):
    """Changes that the target columns cannot take."""


class TargetTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    # --- pointer ---

    def _pointer(self) -> dict:
        versions = files.numbered(self.spark, f"{self.path}/_pointer")
        if not versions:
            return {"generation": 0, "base": None, "compacted": [], "schema": None}
        text = files.read_text(self.spark, f"{self.path}/_pointer/{versions[-1]}.json")
        return json.loads(text)

    def _move(self, **changes) -> dict:
        pointer = {**self._pointer(), **changes}
        versions = files.numbered(self.spark, f"{self.path}/_pointer")
        n = versions[-1] + 1 if versions else 0
        files.write_text(self.spark, f"{self.path}/_pointer/{n}.json", json.dumps(pointer))
        return pointer

    def _folder(self, pointer: dict) -> str:
        return f"{self.path}/gen-{pointer['generation']}"

    def exists(self) -> bool:
        """Whether a first batch has declared the columns."""
        return self._pointer()["schema"] is not None

    # --- writing ---

    def check_columns(self, rows: DataFrame, pointer: dict | None = None) -> None:
        """The target schema is fixed by its first batch; it never follows the source."""
        declared = (pointer or self._pointer())["schema"]
        if declared is None:
            return
        have = {f.name: f.dataType for f in T.StructType.fromJson(declared).fields}
        wrong = [
            f.name
            for f in rows.schema.fields
            if f.name not in HIDDEN and have.get(f.name) != f.dataType
        ]
        if wrong:
            raise SchemaMismatch(f"target {self.path} cannot take columns {wrong}")

    def _groups(self, pointer: dict) -> list[list[str]] | None:
        """Columns that were always carried together; none if every batch carried all."""
        narrow = pointer.get("narrow")
        if not narrow:
            return None
        groups: dict[tuple, list[str]] = {}
        for name in T.StructType.fromJson(pointer["schema"]).fieldNames():
            if name not in (*HIDDEN, *self.keys):
                groups.setdefault(tuple(name in carried for carried in narrow), []).append(name)
        return list(groups.values())

    def apply(self, rows: DataFrame, batch_id: str) -> None:
        """Apply a batch of change rows. The same id again has no further effect.

        Target columns that the rows lack keep their values: each column has its
        own change order from then on, so batches that carry different columns
        may come in any sequence. A key that is deleted and created again has
        nulls in columns no later change carries.
        """
        pointer = self._pointer()
        self.check_columns(rows, pointer)
        if pointer["schema"] is None:
            pointer = self._move(schema=json.loads(rows.schema.json()))
        declared = T.StructType.fromJson(pointer["schema"])
        columns = {f.name: f.dataType for f in declared.fields if f.name not in HIDDEN}
        carried = [c for c in columns if c in rows.columns]
        if set(self.keys) - set(carried):
            raise SchemaMismatch(f"target {self.path} needs the key columns {self.keys}")
        if len(carried) < len(columns):
            known = pointer.get("narrow") or []
            if carried not in known:
                pointer = self._move(narrow=[*known, carried])
            folded = fold_columns(carrying(rows, columns, self.keys), self.keys, self._groups(pointer))
        else:
            folded = fold(rows, self.keys)
        folder = f"{self._folder(pointer)}/delta/batch={batch_id}"
        folded.write.mode("overwrite").parquet(folder)

    def truncate(self) -> None:
        self._move(generation=self._pointer()["generation"] + 1, base=None, compacted=[], narrow=[])

    def compact(self, only_if_due: bool = False, below: int | None = None) -> None:
        """Write a new base from base and deltas, then point to it.

        It is due once the deltas have grown to a tenth of the base, so a large
        base is not rewritten for a few changes. Deleted keys stay as tombstones
        unless their delete is ``below`` a change number that every consumer and
        replay has passed: nothing older than the delete can arrive then.
        """
        pointer = self._pointer()
        done = self._deltas(pointer)
        if (not done and below is None) or (only_if_due and self._small(pointer, done)):
            return
        n = 0 if pointer["base"] is None else pointer["base"] + 1
        state = self.state()
        if below is not None:
            state = state.where(~F.col("_deleted") | (F.col("_scn") >= below))
        state.hint("rebalance", *self.keys).write.mode("overwrite").parquet(f"{self._folder(pointer)}/base-{n}")
        self._move(base=n, compacted=pointer["compacted"] + done)

    def version(self) -> int:
        """The number of the pointer; a reader that notes it can keep what it reads from a vacuum."""
        return max(files.numbered(self.spark, f"{self.path}/_pointer"), default=-1)

    def vacuum(self, oldest: int | None = None) -> None:
        """Delete what no pointer from version ``oldest`` on uses; by default only the newest counts.

        Readers that are still at work with an older version must be counted in.
        A batch whose folder is gone may be applied again at any time: merging by
        change order makes that harmless, so nothing about it has to be kept.
        """
        versions = files.numbered(self.spark, f"{self.path}/_pointer")
        kept = [n for n in versions if n == versions[-1] or (oldest is not None and n >= oldest)]
        pointers = [json.loads(files.read_text(self.spark, f"{self.path}/_pointer/{n}.json")) for n in kept]
        bases = {(p["generation"], p["base"]) for p in pointers}
        for name in files.children(self.spark, self.path):
            generation = name.removeprefix("gen-")
            if not name.startswith("gen-"):
                continue
            mine = [p for p in pointers if str(p["generation"]) == generation]
            if not mine:
                files.remove(self.spark, f"{self.path}/{name}")
                continue
            for base in files.children(self.spark, f"{self.path}/{name}"):
                if base.startswith("base-") and (int(generation), int(base[5:])) not in bases:
                    files.remove(self.spark, f"{self.path}/{name}/{base}")
            unused = set.intersection(*(set(p["compacted"]) for p in mine))
            for batch in unused:
                files.remove(self.spark, f"{self.path}/{name}/delta/{batch}")
        if len(kept) == 1:
            self._move(compacted=[])
            kept = []
        for n in versions:
            if n not in kept:
                files.remove(self.spark, f"{self.path}/_pointer/{n}.json")

    # --- reading ---

    def _deltas(self, pointer: dict) -> list[str]:
        names = files.children(self.spark, f"{self._folder(pointer)}/delta")
        done = set(pointer["compacted"])
        root = f"{self._folder(pointer)}/delta"
        return [
            n
            for n in names
            if n.startswith("batch=")
            and n not in done
            and files.exists(self.spark, f"{root}/{n}/_SUCCESS")
        ]

    def _small(self, pointer: dict, deltas: list[str]) -> bool:
        """Whether some deltas are small next to the base, by file sizes."""
        if pointer["base"] is None:
            return False
        folder = self._folder(pointer)
        delta_bytes = files.size(self.spark, [f"{folder}/delta/{d}" for d in deltas])
        base_bytes = files.size(self.spark, [f"{folder}/base-{pointer['base']}"])
        return delta_bytes * SMALL_SHARE < base_bytes

    def state(self) -> DataFrame:
        """Every key ever seen in this generation, deleted ones flagged."""
        pointer = self._pointer()
        if pointer["schema"] is None:
            raise FileNotFoundError(f"no target at {self.path}")
        schema, groups = T.StructType.fromJson(pointer["schema"]), self._groups(pointer)
        if groups is not None:
            # Folders written before the first narrow batch lack the column: null, all at the row's order.
            schema = T.StructType([*schema.fields, T.StructField(COLUMN_ORDER, T.MapType(T.StringType(), _order_type(schema)))])
        folder = self._folder(pointer)
        deltas = self._deltas(pointer)
        read = self.spark.read.schema(schema)
        base = None if pointer["base"] is None else read.parquet(f"{folder}/base-{pointer['base']}")
        if not deltas:
            return base if base is not None else self.spark.createDataFrame([], schema)
        new = read.parquet(*[f"{folder}/delta/{d}" for d in deltas])
        if base is None:
            if len(deltas) == 1:
                return new
            return fold(new, self.keys) if groups is None else fold_columns(new, self.keys, groups)
        return merge_batch(base, new, self.keys, small_batch=self._small(pointer, deltas), groups=groups)

    def read(self) -> DataFrame:
        return live(self.state())

    def max_scn(self) -> DataFrame:
        return self.state().agg(F.max("_scn").alias("max_scn"))
