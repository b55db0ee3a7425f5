"""Source against target."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reconcile as R
from tidemark.workload import query
from tidemark.workload.inputs import table

_HASH = "CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"
_TEXT = (
    "CAST(o_orderkey AS VARCHAR) || '|' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR)"
    " || '|' || coalesce({status}, '~null~')"
)
_SUM = "CAST(sum({h}) AS VARCHAR)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"), "o_orderstatus"
    )


COLUMNS = ["o_orderkey", "price", "o_orderstatus"]


@query(
    f"SELECT count(*) AS row_count, {_SUM.format(h=_HASH.format(text=_TEXT.format(status='o_orderstatus')))}"
    " AS checksum FROM orders"
)
def table_checksum(spark, sf_dir):
    return R.checksum(_orders(spark, sf_dir), COLUMNS).select(
        "row_count", F.col("checksum").cast("string").alias("checksum")
    )


_DAMAGED = "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END"


@query(
    f"""SELECT count(*) AS source_rows, count(*) AS target_rows,
      {_SUM.format(h=_HASH.format(text=_TEXT.format(status='o_orderstatus')))} AS source_checksum,
      {_SUM.format(h=_HASH.format(text=_TEXT.format(status=_DAMAGED)))} AS target_checksum,
      false AS matched FROM orders"""
)
def reconcile_damaged(spark, sf_dir):
    """The target lost one status value."""
    source = _orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    found = R.reconcile(source, source.withColumn("o_orderstatus", status), COLUMNS)
    return found.withColumns(
        {c: F.col(c).cast("string") for c in ("source_checksum", "target_checksum")}
    )


@query(
    """SELECT count(*) AS source_rows, count(*) AS target_rows, true AS matched FROM lineitem"""
)
def reconcile_reordered(spark, sf_dir):
    """The same rows in another order and layout match."""
    rows = table(spark, sf_dir, "lineitem")
    money = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = rows.withColumns({c: F.col(c).cast("decimal(14,2)") for c in money})
    found = R.reconcile(rows, rows.repartition("l_partkey"), rows.columns)
    return found.select("source_rows", "target_rows", "matched")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
)
def orphan_rows(spark, sf_dir):
    """Target rows whose order the source no longer has."""
    source = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    target = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.orphans(source, target, ["o_orderkey"]).select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey"
    )


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def duplicate_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
