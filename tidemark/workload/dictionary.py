"""Dictionary relations, mappings and registration rules.

The stand-in dictionary has one table per order and one column per line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mapping as mp, registration as reg
from tidemark.workload import query
from tidemark.workload.inputs import table

TABLES = """SELECT 'S' || CAST(o_custkey % 5 AS VARCHAR) AS schema_name,
  'T_' || CAST(o_orderkey AS VARCHAR) AS table_name,
  CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS num_rows, o_orderkey AS k FROM orders"""

COLUMNS = f"""SELECT DISTINCT t.schema_name, t.table_name, 'C' || CAST(l_linenumber AS VARCHAR) AS column_name,
  'NUMBER' AS data_type, l_linenumber AS column_id, k FROM lineitem JOIN ({TABLES}) t ON k = l_orderkey"""

INFO = f"""SELECT schema_name, table_name, k % 6 > 0 AS has_pk, k % 7 > 0 AS supp_log_all, num_rows, k
  FROM ({TABLES})"""

PK_COLUMNS = f"""SELECT *, k % 6 > 0 AND column_id <= 2 AS is_pk FROM ({COLUMNS})"""


def _tables(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("schema_name"),
        F.concat(F.lit("T_"), F.col("o_orderkey").cast("string")).alias("table_name"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("num_rows"),
        F.col("o_orderkey").alias("k"),
    )


def _constraints(spark, sf_dir):
    """A primary key and a check per table; tables with k % 6 = 0 have no key."""
    rows = _tables(spark, sf_dir)
    kinds = F.when(F.col("k") % 6 > 0, F.array(F.lit("P"), F.lit("C"))).otherwise(
        F.array(F.lit("C"))
    )
    return rows.select("schema_name", "table_name", F.explode(kinds).alias("constraint_type")).select(
        "*", F.concat_ws("_", "constraint_type", "table_name").alias("constraint_name")
    )


def _log_groups(spark, sf_dir):
    kind = F.when(F.col("k") % 7 > 0, "ALL COLUMN LOGGING").otherwise("PRIMARY KEY LOGGING")
    return _tables(spark, sf_dir).select(
        "schema_name", "table_name", kind.alias("log_group_type")
    )


def _columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("column_id")
    )
    lines = reg.spread(lines, "k").distinct()
    return lines.join(reg.spread(_tables(spark, sf_dir), "k"), "k").select(
        "schema_name",
        "table_name",
        F.concat(F.lit("C"), F.col("column_id").cast("string")).alias("column_name"),
        F.lit("NUMBER").alias("data_type"),
        "column_id",
        "k",
    )


def _info(spark, sf_dir):
    return reg.list_tables(
        _tables(spark, sf_dir), _constraints(spark, sf_dir), _log_groups(spark, sf_dir)
    )


def _pk_columns(spark, sf_dir):
    columns = _columns(spark, sf_dir)
    keys = columns.where("column_id <= 2").select(
        "schema_name",
        "table_name",
        "column_name",
        F.concat(F.lit("P_"), F.col("table_name")).alias("constraint_name"),
    )
    return reg.list_columns(columns, _constraints(spark, sf_dir), keys)


@query(
    f"SELECT schema_name, table_name FROM ({TABLES}) WHERE schema_name = 'S1' AND table_name LIKE 'T_%1_'"
)
def table_discovery(spark, sf_dir):
    return reg.discover(_tables(spark, sf_dir), "s1.t_*1_").select("schema_name", "table_name")


@query(f"SELECT schema_name, table_name, has_pk, supp_log_all, num_rows FROM ({INFO})")
def table_list(spark, sf_dir):
    return _info(spark, sf_dir)


@query(
    f"SELECT schema_name, table_name, column_name, data_type, column_id, is_pk FROM ({PK_COLUMNS})"
)
def column_list(spark, sf_dir):
    return _pk_columns(spark, sf_dir)


# --- mappings ---------------------------------------------------------------------------
# Targets have the odd columns under their own name and the even ones renamed.

_TARGETS = f"""SELECT schema_name, table_name,
  CASE WHEN column_id % 2 = 1 THEN lower(column_name) ELSE column_name || '_X' END AS column_name
  FROM ({COLUMNS})"""


def _targets(spark, sf_dir):
    name = F.when(F.col("column_id") % 2 == 1, F.lower("column_name")).otherwise(
        F.concat(F.col("column_name"), F.lit("_X"))
    )
    return _columns(spark, sf_dir).select("schema_name", "table_name", name.alias("column_name"))


@query(
    f"""SELECT schema_name, table_name, column_name AS target_column,
      CASE WHEN column_name NOT LIKE '%_X' THEN '${{' || column_name || '}}' ELSE '' END AS source_expr,
      column_name NOT LIKE '%_X' AS enabled FROM ({_TARGETS})"""
)
def auto_map(spark, sf_dir):
    return mp.auto_map(_columns(spark, sf_dir), _targets(spark, sf_dir))


@query(
    f"""SELECT schema_name, table_name, column_name AS target_column,
      '${{' || column_name || '}}' AS source_expr, true AS enabled FROM ({COLUMNS})"""
)
def default_mapping(spark, sf_dir):
    return mp.default_mapping(_columns(spark, sf_dir))


# Mapping rows of a spec: one per column; expression and flag vary with the table.
_MAPPINGS = f"""SELECT k AS spec_no, column_id AS position, schema_name, table_name,
  CASE WHEN k % 17 = 1 AND column_id = 3 THEN ' '
       WHEN k % 10 = 3 AND column_id >= 3 THEN column_name || '_R' ELSE column_name END AS target_column,
  CASE WHEN k % 19 = 1 AND column_id = 2 THEN '${{UPPER(' || column_name || ')}}'
       WHEN k % 23 = 1 AND column_id = 2 THEN '${{NOPE}}'
       ELSE ' ${{' || lower(column_name) || '}} ' END AS source_expr,
  NOT (k % 29 = 1 AND column_id = 1) AND NOT (k % 3 = 1 AND column_id = 4) AS enabled
  FROM ({COLUMNS})"""


def _mappings(spark, sf_dir):
    k, c, name = F.col("k"), F.col("column_id"), F.col("column_name")
    target = (
        F.when((k % 17 == 1) & (c == 3), " ")
        .when((k % 10 == 3) & (c >= 3), F.concat(name, F.lit("_R")))
        .otherwise(name)
    )
    wrapped = lambda e: F.concat(F.lit("${"), e, F.lit("}"))
    expr = (
        F.when((k % 19 == 1) & (c == 2), wrapped(F.concat(F.lit("UPPER("), name, F.lit(")"))))
        .when((k % 23 == 1) & (c == 2), "${NOPE}")
        .otherwise(F.concat(F.lit(" "), wrapped(F.lower(name)), F.lit(" ")))
    )
    on = ~((k % 29 == 1) & (c == 1)) & ~((k % 3 == 1) & (c == 4))
    return _columns(spark, sf_dir).select(
        k.alias("spec_no"),
        c.alias("position"),
        "schema_name",
        "table_name",
        target.alias("target_column"),
        expr.alias("source_expr"),
        on.alias("enabled"),
    )


_PARSED = f"""SELECT *, nullif(upper(regexp_extract(trim(source_expr),
    '^\\$\\{{([A-Za-z][A-Za-z0-9_#$]*)\\}}$', 1)), '') AS src FROM ({_MAPPINGS})"""


@query(
    f"""SELECT schema_name, table_name, n_mapped, n_loaded,
      CASE WHEN n_mapped <> n_loaded THEN coalesce(names, '') END AS include_list FROM (
        SELECT schema_name, table_name, count(*) AS n_mapped,
          count_if(enabled AND coalesce(upper(target_column) = src, false)) AS n_loaded,
          string_agg(CASE WHEN enabled AND upper(target_column) = src THEN src END, ',' ORDER BY position) AS names
        FROM ({_PARSED}) GROUP BY 1, 2)"""
)
def include_filters(spark, sf_dir):
    return mp.include_filter(_mappings(spark, sf_dir))


# --- registration --------------------------------------------------------------------------

_SPECS = f"""SELECT k AS spec_no, schema_name, table_name,
  CASE WHEN k % 31 = 1 THEN schema_name || '.*'
       WHEN k % 37 = 1 THEN schema_name || '.MISSING_' || CAST(k AS VARCHAR)
       ELSE lower(schema_name) || '.' || table_name END AS source,
  CASE WHEN k % 41 = 1 THEN 'SOMETIMES' WHEN k % 2 = 0 THEN 'no_data' END AS mode,
  CASE WHEN k % 5 = 0 THEN ' tgt ' ELSE ' ' END AS target_schema, k FROM ({TABLES})"""


def _specs(spark, sf_dir):
    k = F.col("k")
    source = (
        F.when(k % 31 == 1, F.concat(F.col("schema_name"), F.lit(".*")))
        .when(k % 37 == 1, F.concat(F.col("schema_name"), F.lit(".MISSING_"), k.cast("string")))
        .otherwise(F.concat(F.lower("schema_name"), F.lit("."), F.col("table_name")))
    )
    return _tables(spark, sf_dir).select(
        k.alias("spec_no"),
        source.alias("source"),
        F.when(k % 41 == 1, "SOMETIMES").when(k % 2 == 0, "no_data").alias("snapshot_mode"),
        F.when(k % 5 == 0, " tgt ").otherwise(" ").alias("target_schema"),
        F.lit(None).cast("string").alias("target_table"),
    )


def _registered(spark, sf_dir):
    """Some tables are registered already, some under another schema."""
    schema = F.when(F.col("k") % 43 == 1, "ELSEWHERE").otherwise(F.col("schema_name"))
    rows = _tables(spark, sf_dir).where("k % 43 = 1 OR k % 47 = 1")
    return rows.select(
        schema.alias("schema_name"),
        "table_name",
        F.col("k").alias("id"),
        F.when(F.col("k") % 2 == 0, "no_data").otherwise("INITIAL").alias("snapshot_mode"),
    )


@query(
    f"""WITH p AS ({_PARSED}), c AS (SELECT * FROM ({PK_COLUMNS})), m AS (
      SELECT p.spec_no, min_by(reason, position) AS bad FROM (
        SELECT p.*, CASE WHEN trim(target_column) = '' THEN 'target column is blank' WHEN NOT enabled THEN NULL
            WHEN src IS NULL THEN 'mapping expression does not parse'
            WHEN src = 'NOPE' THEN 'mapping names an unknown source column' END AS reason FROM p) p
      WHERE reason IS NOT NULL GROUP BY p.spec_no),
    u AS (SELECT DISTINCT c.k AS spec_no FROM c WHERE is_pk AND NOT EXISTS (
        SELECT 1 FROM p WHERE p.spec_no = c.k AND p.enabled AND p.src = c.column_name
          AND upper(p.target_column) = p.src))
    SELECT s.spec_no, CASE WHEN reason IS NULL THEN true ELSE false END AS accepted, reason,
           CASE WHEN target_schema = ' tgt ' THEN 'TGT' ELSE schema_name END AS target_schema,
           coalesce(upper(mode), 'INITIAL') AS snapshot_mode
    FROM (SELECT s.*, CASE WHEN mode = 'SOMETIMES' THEN 'snapshot mode unknown'
        WHEN s.k % 31 = 1 THEN 'wildcard or malformed name' WHEN s.k % 37 = 1 THEN 'table not in source'
        WHEN s.k % 6 = 0 THEN 'no primary key' WHEN s.k % 7 = 0 THEN 'change logging not set'
        WHEN s.k % 47 = 1 AND s.k % 43 <> 1 THEN 'already registered'
        WHEN s.k % 43 = 1 THEN 'same table name under another schema'
        WHEN m.bad IS NOT NULL THEN m.bad
        WHEN u.spec_no IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.spec_no = s.spec_no)
          THEN 'primary key not fully mapped' END AS reason
      FROM ({_SPECS}) s LEFT JOIN m ON m.spec_no = s.spec_no LEFT JOIN u ON u.spec_no = s.spec_no) s"""
)
def registration_rules(spark, sf_dir):
    info, columns = _info(spark, sf_dir), _pk_columns(spark, sf_dir)
    found = reg.validate_registration(
        _specs(spark, sf_dir), _mappings(spark, sf_dir).drop("schema_name", "table_name"),
        info, columns, _registered(spark, sf_dir),
    )
    return found.select("spec_no", "accepted", "reason", "target_schema", "snapshot_mode")


@query(
    f"""SELECT CASE WHEN min_by(k, k) % 2 = 0 THEN 'no_data' ELSE 'initial' END AS snapshot_mode
        FROM ({TABLES}) WHERE k % 43 = 1 OR k % 47 = 1"""
)
def effective_snapshot_mode(spark, sf_dir):
    return reg.effective_snapshot_mode(_registered(spark, sf_dir))


@query(
    """SELECT c_custkey, coalesce(c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0, false) AS accepted FROM customer"""
)
def connection_roles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pairs = c.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "SOURCE").otherwise("TARGET").alias("source_role"),
        F.when(F.col("c_nationkey") % 2 == 0, "TARGET").alias("target_role"),
    )
    return reg.check_roles(pairs).select("c_custkey", "accepted")
