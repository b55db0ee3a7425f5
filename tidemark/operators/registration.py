"""Dictionary relations and the rules a table must pass to be registered.

Inputs are relations, so one job checks any number of tables:

- ``specs``: spec_no, source, target_schema, target_table, snapshot_mode
- ``mappings``: spec_no, position, target_column, source_expr, enabled
- ``tables``: schema_name, table_name, has_pk, supp_log_all
- ``columns``: schema_name, table_name, column_name, is_pk
- ``registered``: schema_name, table_name
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalars import upper_or_null
from tidemark.functions.text import is_identity, source_column

TABLE = ["schema_name", "table_name"]

# Constraint type of a primary key, log group type of full logging.
PRIMARY_KEY = "P"
ALL_COLUMN_LOGGING = "ALL COLUMN LOGGING"

# Snapshot modes and connection roles.
SNAPSHOT_MODES = ("INITIAL", "NO_DATA")
SOURCE_ROLE, TARGET_ROLE = "SOURCE", "TARGET"

#: Tasks for each core that ``spread`` deals rows to.
TASKS_PER_CORE = 8


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to a number of tasks that adaptive execution keeps.

    It joins small partitions by their compressed size, and names that differ
    in a few digits compress so well that one task would sort many times that.
    """
    spark = rows.sparkSession
    n = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        TASKS_PER_CORE * spark.sparkContext.defaultParallelism,
    )
    return rows.repartition(n, *keys)


# --- dictionary --------------------------------------------------------------


def parse_pattern(pattern: str) -> tuple[str, str]:
    """Schema and LIKE pattern of ``SCHEMA.TABLE``, where ``*`` matches anything."""
    schema, dot, table = (pattern or "").partition(".")
    schema, table = schema.strip().upper(), table.strip().upper().replace("*", "%")
    if not dot or not schema or not table:
        raise ValueError(f"pattern must be SCHEMA.TABLE: {pattern}")
    return schema, table


def discover(tables: DataFrame, pattern: str) -> DataFrame:
    schema, like = parse_pattern(pattern)
    return tables.where((F.col("schema_name") == schema) & F.col("table_name").like(like))


def list_tables(
    tables: DataFrame, constraints: DataFrame, log_groups: DataFrame, pattern: str | None = None
) -> DataFrame:
    """Tables with ``has_pk`` and ``supp_log_all``, in name order."""
    if pattern is not None:
        tables = discover(tables, pattern)
    pk = (
        spread(constraints.where(F.col("constraint_type") == PRIMARY_KEY), *TABLE)
        .groupBy(*TABLE)
        .agg(F.count(F.lit(1)).alias("_pk"))
    )
    logged = (
        spread(log_groups.where(F.col("log_group_type") == ALL_COLUMN_LOGGING), *TABLE)
        .groupBy(*TABLE)
        .agg(F.count(F.lit(1)).alias("_log"))
    )
    return (
        spread(tables, *TABLE)
        .join(pk, TABLE, "left")
        .join(logged, TABLE, "left")
        .select(
            *TABLE,
            (F.coalesce("_pk", F.lit(0)) > 0).alias("has_pk"),
            (F.coalesce("_log", F.lit(0)) > 0).alias("supp_log_all"),
            "num_rows",
        )
        .orderBy(*TABLE)
    )


def list_columns(
    columns: DataFrame, constraints: DataFrame, constraint_columns: DataFrame
) -> DataFrame:
    """Columns with ``is_pk``."""
    constraint = ["schema_name", "constraint_name"]
    pk = (
        spread(constraints.where(F.col("constraint_type") == PRIMARY_KEY), *constraint)
        .join(spread(constraint_columns.drop("table_name"), *constraint), constraint)
        .select(*TABLE, "column_name")
    )
    pk = spread(pk, *TABLE, "column_name").distinct().withColumn("_pk", F.lit(True))
    return spread(columns, *TABLE, "column_name").join(pk, [*TABLE, "column_name"], "left").select(
        *TABLE,
        "column_name",
        "data_type",
        "column_id",
        F.coalesce("_pk", F.lit(False)).alias("is_pk"),
    )


def catalog_columns(spark, database: str) -> DataFrame:
    """The session catalog as a column relation."""
    rows = []
    for t in spark.catalog.listTables(database):
        if t.isTemporary:
            continue
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}")):
            rows.append((database.upper(), t.name.upper(), c.name.upper(), c.dataType, i + 1))
    return spark.createDataFrame(
        rows,
        "schema_name string, table_name string, column_name string, data_type string, column_id int",
    )


# --- rules -------------------------------------------------------------------


_MAPPING_REASONS = (
    "target column is blank",
    "mapping expression does not parse",
    "mapping names an unknown source column",
)


def _mapping_errors(named: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per spec with mappings: reason of its first bad mapping, else of uncovered key columns.

    Mapping rows and dictionary columns meet in one grouping by spec and column
    name, which says per name whether it exists, is a key, and is loaded as it is.
    """
    name, enabled = source_column("source_expr"), F.col("enabled")
    blank = F.trim(F.coalesce("target_column", F.lit(""))) == ""
    # Position and reason travel as one number, which keeps the grouping a hash aggregate.
    at = F.col("position").cast("bigint") * len(_MAPPING_REASONS)
    own = F.when(blank, at).when(enabled & name.isNull(), at + 1)
    nothing = F.lit(None).cast("boolean")
    mapped = mappings.select(
        "spec_no",
        name.alias("_name"),
        own.alias("_own"),
        F.when(~blank & enabled & name.isNotNull(), at + 2).alias("_looked_up"),
        nothing.alias("_pk"),
        (enabled & is_identity("target_column", "source_expr")).alias("_loaded"),
        F.lit(True).alias("_mapped"),
    )
    known = spread(named.select("spec_no", *TABLE), *TABLE).join(spread(columns, *TABLE), TABLE).select(
        "spec_no",
        F.upper("column_name").alias("_name"),
        F.lit(None).cast("bigint").alias("_own"),
        F.lit(None).cast("bigint").alias("_looked_up"),
        F.col("is_pk").alias("_pk"),
        nothing.alias("_loaded"),
        nothing.alias("_mapped"),
    )
    per_name = spread(mapped.unionByName(known), "spec_no").groupBy("spec_no", "_name").agg(
        F.min("_own").alias("_own"),
        F.min("_looked_up").alias("_looked_up"),
        F.max("_pk").alias("_pk"),
        F.max("_loaded").alias("_loaded"),
        F.max("_mapped").alias("_mapped"),
    )
    bad = F.least(F.col("_own"), F.when(F.col("_pk").isNull(), F.col("_looked_up")))
    uncovered = F.col("_pk") & ~F.coalesce("_loaded", F.lit(False))
    return (
        per_name.groupBy("spec_no")
        .agg(
            F.min(bad).alias("_bad"),
            F.max(uncovered).alias("_uncovered"),
            F.max("_mapped").alias("_mapped"),
        )
        .where("_mapped")
        .select(
            "spec_no",
            F.coalesce(
                F.get(
                    F.array(*[F.lit(r) for r in _MAPPING_REASONS]),
                    (F.col("_bad") % len(_MAPPING_REASONS)).cast("int"),
                ),
                F.when(F.col("_uncovered"), "primary key not fully mapped"),
            ).alias("_mapping_reason"),
        )
    )


def validate_registration(
    specs: DataFrame,
    mappings: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    registered: DataFrame,
    all_or_nothing: bool = False,
) -> DataFrame:
    """Each spec with ``accepted`` and the ``reason`` it was refused for.

    A spec without mappings maps every column onto itself. With
    ``all_or_nothing`` one refusal refuses the whole batch, the others then
    carry no reason of their own.
    """
    malformed = F.coalesce(F.col("source").rlike("[*%]"), F.lit(True)) | (
        F.instr("source", ".") < 2
    )
    named = specs.withColumns(
        {
            "schema_name": F.upper(F.trim(F.substring_index("source", ".", 1))),
            "table_name": F.upper(F.trim(F.expr("substring(source, instr(source, '.') + 1)"))),
            "snapshot_mode": F.coalesce(F.upper("snapshot_mode"), F.lit("INITIAL")),
            "target_schema": upper_or_null("target_schema"),
            "target_table": upper_or_null("target_table"),
        }
    )
    known = tables.select(*TABLE, "has_pk", "supp_log_all", F.lit(True).alias("_known"))
    # The few schemas that a table name is registered under.
    schemas = registered.groupBy("table_name").agg(F.collect_set("schema_name").alias("_schemas"))
    exact = F.array_contains("_schemas", F.col("schema_name"))
    other_schema = F.exists("_schemas", lambda s: s != F.col("schema_name"))
    checked = (
        spread(named, "spec_no")
        .join(_mapping_errors(named, columns, mappings), "spec_no", "left")
        .transform(spread, *TABLE)
        .join(spread(known, *TABLE), TABLE, "left")
        .transform(spread, "table_name")
        .join(schemas, "table_name", "left")
        .withColumn(
            "reason",
            F.when(~F.col("snapshot_mode").isin(*SNAPSHOT_MODES), "snapshot mode unknown")
            .when(malformed, "wildcard or malformed name")
            .when(F.col("_known").isNull(), "table not in source")
            .when(~F.col("has_pk"), "no primary key")
            .when(~F.col("supp_log_all"), "change logging not set")
            .when(exact, "already registered")
            .when(other_schema, "same table name under another schema")
            .otherwise(F.col("_mapping_reason")),
        )
    )
    # A table name can be won once per batch, by its first valid spec; the rules are evaluated once for both.
    # Refused specs win nothing and lose nothing, so they are dealt by number: many share a name such as "*".
    own = F.struct(F.col("spec_no").alias("no"), F.col("schema_name").alias("schema"))
    winner = F.min(F.when(F.col("reason").isNull(), own)).over(Window.partitionBy("table_name", "_refused"))
    late = F.col("reason").isNull() & (F.col("spec_no") > F.col("_winner.no"))
    clash = F.when(F.col("_winner.schema") == F.col("schema_name"), "already registered").otherwise(
        "same table name under another schema"
    )
    out = (
        checked.select("spec_no", *TABLE, "target_schema", "target_table", "snapshot_mode", "reason")
        .withColumn("_refused", F.when(F.col("reason").isNotNull(), F.col("spec_no")))
        .transform(spread, "table_name", "_refused")
        .withColumn("_winner", winner)
        .withColumn("reason", F.when(late, clash).otherwise(F.col("reason")))
    )
    accepted = F.col("reason").isNull()
    if all_or_nothing:
        refused = out.agg(F.count_if(F.col("reason").isNotNull())).scalar()
        accepted = accepted & (refused == 0)
    return out.select(
        "spec_no",
        "schema_name",
        "table_name",
        F.coalesce("target_schema", "schema_name").alias("target_schema"),
        F.coalesce("target_table", "table_name").alias("target_table"),
        "snapshot_mode",
        accepted.alias("accepted"),
        "reason",
    )


def effective_snapshot_mode(registered: DataFrame) -> DataFrame:
    """One row: the mode of the oldest registration decides for all tables."""
    mode = F.min_by(F.upper("snapshot_mode"), "id")
    return registered.agg(
        F.when(mode == "NO_DATA", "no_data").otherwise("initial").alias("snapshot_mode")
    )


def check_roles(connections: DataFrame) -> DataFrame:
    """Connection pairs with ``accepted``: the first must be a source, the second a target."""
    ok = (F.col("source_role") == SOURCE_ROLE) & (F.col("target_role") == TARGET_ROLE)
    return connections.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def registry_rows(validated: DataFrame) -> DataFrame:
    """The accepted specs as registry rows."""
    from tidemark.functions.scalars import table_suffix

    return validated.where("accepted").select(
        F.col("spec_no").alias("id"),
        *TABLE,
        "target_schema",
        "target_table",
        "snapshot_mode",
        table_suffix("schema_name", "table_name").alias("suffix"),
    )
