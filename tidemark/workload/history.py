"""Earlier states, snapshots in chunks, and differences row by row."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.operators import history, state
from tidemark.operators.diff import row_diff
from tidemark.operators.incremental import plan_chunks
from tidemark.plans import jobs
from tidemark.session import shared_dir
from tidemark.sinks.target import TargetTable
from tidemark.workload import query
from tidemark.workload.changes import KEYS, STATE
from tidemark.workload.inputs import OPS, as_changes, changes, ops, table

# Three events share a change number, so ties are common.
_TIED = f"WITH ops AS (SELECT * REPLACE (event_id // 3 AS scn) FROM ({OPS}))"


def _tied_rows(spark, sf_dir):
    rows = ops(spark, sf_dir).withColumns({"scn": F.expr("event_id div 3").cast("string"), "tx_id": F.lit("t")})
    return state.change_rows(as_changes(rows), "event_id")


@query(
    f"""{_TIED}, points AS (SELECT q, (SELECT max(scn) FROM ops) * q // 4 AS at_scn FROM range(1, 4) AS r(q)),
    last AS (
      SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY event_id DESC) AS rn
      FROM ops JOIN points ON scn <= at_scn
    )
    SELECT at_scn, id, CAST(amt AS DOUBLE) AS amt, st FROM last WHERE rn = 1 AND op <> 'd'"""
)
def state_at_numbers(spark, sf_dir):
    """The table as it was at a quarter, the half and three quarters of the change numbers."""
    rows = _tied_rows(spark, sf_dir)
    last = rows.agg(F.max("_scn")).first()[0]
    found = []
    for at in (last * q // 4 for q in (1, 2, 3)):
        seen = history.state_as_of(rows, KEYS, at)
        found.append(seen.select(
            F.lit(at).cast("bigint").alias("at_scn"), F.col("ID").alias("id"), F.col("AMT").cast("double").alias("amt"),
            F.col("ST").alias("st"),
        ))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    f"""{_TIED}, seen AS (
      SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY id, scn ORDER BY event_id DESC) = 1
    ), ended AS (SELECT *, lead(scn) OVER (PARTITION BY id ORDER BY scn) AS valid_to FROM seen)
    SELECT id, CAST(amt AS DOUBLE) AS amt, st, scn AS valid_from, valid_to FROM ended WHERE op <> 'd'"""
)
def row_versions(spark, sf_dir):
    """All versions of all rows with the change numbers they were valid for."""
    return history.row_versions(_tied_rows(spark, sf_dir), KEYS).select(
        F.col("ID").alias("id"), F.col("AMT").cast("double").alias("amt"), F.col("ST").alias("st"),
        "valid_from", "valid_to",
    )


@query(
    f"""{_TIED}, seen AS (
      SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY id, scn ORDER BY event_id DESC) = 1
    ), keys AS (SELECT max(id) + 1 AS k, (SELECT max(scn) + 1 FROM ops) AS s FROM ops),
    facts AS (SELECT l_orderkey, l_linenumber, l_orderkey % k AS id, l_partkey % s AS at_scn FROM lineitem, keys)
    SELECT l_orderkey, l_linenumber, f.id, at_scn, CASE WHEN op <> 'd' THEN CAST(amt AS DOUBLE) END AS amt,
           CASE WHEN op <> 'd' THEN st END AS st
    FROM facts f ASOF LEFT JOIN seen s ON f.id = s.id AND f.at_scn >= s.scn"""
)
def as_of_lookup(spark, sf_dir):
    """Every line item with the row of its key as it was at the line's change number."""
    rows = _tied_rows(spark, sf_dir)
    ends = rows.agg(F.max("ID") + 1, F.max("_scn") + 1).first()
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % ends[0]).alias("ID"), (F.col("l_partkey") % ends[1]).alias("at_scn")
    )
    return history.as_of_join(facts, rows, KEYS, "at_scn").select(
        "l_orderkey", "l_linenumber", F.col("ID").alias("id"), "at_scn", F.col("AMT").cast("double").alias("amt"),
        F.col("ST").alias("st"),
    )


@query(STATE)
def incremental_snapshot(spark, sf_dir):
    """A target that missed the first changes and holds strays, loaded in chunks while changes go on."""
    events = changes(spark, sf_dir)
    rows = state.change_rows(events, "event_id")
    last = rows.agg(F.max("_scn")).first()[0]
    root = shared_dir(spark, "chunks")
    target = TargetTable(spark, f"{root}/target", KEYS)
    missed = last // 10
    stray = F.struct((-F.col("ID") - 1).alias("ID"), "AMT", F.lit("stray").alias("ST"))
    strays = rows.select("*", stray.alias("s")).select("s.*", *state.HIDDEN).where("NOT _deleted")
    target.apply(strays.where(F.col("_scn") < missed), "strays")
    # The source is read somewhere between a chunk's low and its high number.
    numbers = itertools.count(1)
    plan = plan_chunks(rows, "ID", -(-rows.count() // 4))
    size = plan.count()
    step = (last - missed) // (2 * size)
    now = [missed]

    def position():
        now[0] = missed + next(numbers) * step
        return now[0]

    def read_range(here):
        return history.state_as_of(rows, KEYS, now[0] + step // 2).where(here)

    half = missed + size * step
    target.apply(rows.where(F.col("_scn").between(missed, half)), "first changes")
    jobs.incremental_snapshot(
        spark, plan, read_range, position, lambda: events, target, "ID", "CDC", "USERS", 0, f"{root}/work"
    )
    target.apply(rows.where(F.col("_scn") >= half), "last changes")
    return target.read().select(
        F.col("ID").alias("id"), F.col("AMT").cast("double").alias("amt"), F.col("ST").alias("st")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' ELSE 'changed' END AS difference,
              CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'price' ELSE 'price,status' END AS changed
       FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 1
       UNION ALL SELECT -o_orderkey - 1, 'extra', '' FROM orders WHERE o_orderkey % 89 = 0"""
)
def row_differences(spark, sf_dir):
    """Orders that a target lost, gained or has otherwise, found by checksums of key ranges."""
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"), F.col("o_orderstatus").alias("status")
    )
    altered = F.col("o_orderkey") % 101 == 1
    target = source.where("o_orderkey % 97 <> 0").withColumns({
        "price": F.when(altered, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(14,2)"),
        "status": F.when(~altered | (F.col("o_custkey") % 2 == 0), F.col("status")),
    })
    extra = source.where("o_orderkey % 89 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    found = row_diff(source, target.unionByName(extra).repartition("o_custkey"), ["o_orderkey"])
    return found.select("o_orderkey", "difference", F.array_join(F.array_sort("changed_columns"), ",").alias("changed"))
