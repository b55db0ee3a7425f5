"""Column mappings ``target_column <- ${SOURCE}`` with an enabled flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import is_identity, source_column


def with_parsed(mappings: DataFrame) -> DataFrame:
    """Add ``source_column`` (null when the expression does not parse) and ``identity``."""
    return mappings.withColumns(
        {
            "source_column": source_column("source_expr"),
            "identity": is_identity("target_column", "source_expr"),
        }
    )


def default_mapping(source_columns: DataFrame) -> DataFrame:
    """Every source column onto itself."""
    return source_columns.select(
        "schema_name",
        "table_name",
        F.col("column_name").alias("target_column"),
        F.concat(F.lit("${"), F.col("column_name"), F.lit("}")).alias("source_expr"),
        F.lit(True).alias("enabled"),
    )


def auto_map(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Target columns onto source columns of the same name; the rest stay off and empty."""
    table = ["schema_name", "table_name"]
    names = source_columns.select(
        *table, F.upper("column_name").alias("_name"), F.lit(True).alias("_found")
    ).distinct()
    rows = target_columns.withColumn("_name", F.upper("column_name"))
    found = F.coalesce("_found", F.lit(False))
    expr = F.concat(F.lit("${"), F.col("column_name"), F.lit("}"))
    return rows.join(names, [*table, "_name"], "left").select(
        *table,
        F.col("column_name").alias("target_column"),
        F.when(found, expr).otherwise("").alias("source_expr"),
        found.alias("enabled"),
    )


def include_filter(mappings: DataFrame) -> DataFrame:
    """Per table the loaded columns as a list text, null when no filter is needed.

    Loaded are enabled mappings onto the same name; renamed columns are kept as
    mappings but not loaded.
    """
    loaded = F.col("enabled") & F.col("identity")
    names = F.collect_list(
        F.when(loaded, F.struct(F.col("position"), F.col("source_column").alias("name")))
    )
    text = F.concat_ws(",", F.transform(F.sort_array(names), lambda e: e["name"]))
    return (
        with_parsed(mappings)
        .groupBy("schema_name", "table_name")
        .agg(
            F.count(F.lit(1)).alias("n_mapped"),
            F.count_if(loaded).alias("n_loaded"),
            text.alias("_text"),
        )
        .withColumn(
            "include_list", F.when(F.col("n_mapped") != F.col("n_loaded"), F.col("_text"))
        )
        .drop("_text")
    )


def loaded_columns(table: DataFrame, mappings: list[tuple[str, str, bool]]) -> list[str]:
    """Columns of ``table`` that the mappings of this one table load, in mapping order.

    A mapping list is as long as the table is wide, so it is a plain argument.
    Without mappings every column is loaded.
    """
    import re

    from tidemark.functions.text import MAPPING_PATTERN

    if not mappings:
        return list(table.columns)
    by_name = {c.upper(): c for c in table.columns}
    kept = []
    for target, expr, enabled in mappings:
        m = re.match(MAPPING_PATTERN, expr.strip())
        if enabled and m and m.group(1).upper() == target.upper():
            kept.append(by_name[m.group(1).upper()])
    return kept


def apply_mapping(table: DataFrame, mappings: list[tuple[str, str, bool]]) -> DataFrame:
    return table.select(*loaded_columns(table, mappings))
