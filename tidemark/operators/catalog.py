"""Joins over table metadata: constraints, suggestions and bound columns.

``constraints``  constraint_schema, constraint_name, constraint_type, table_name
``key_columns``  constraint_schema, constraint_name, column_name, ordinal
``referenced``   constraint_schema, constraint_name, table_name, column_name, ordinal
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.names import normalised_name
from tidemark.operators.mirror import first_per_key

NAME = ["constraint_schema", "constraint_name"]


def _column_list(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Column names of a key in ordinal order; a key has as many as its table at most."""
    pairs = F.array_sort(F.collect_set(F.struct("ordinal", "column_name")))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(pairs, lambda p: p["column_name"]), ", ").alias(name)
    )


def constraint_list(
    constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame
) -> DataFrame:
    """Every constraint with its columns and, per referenced column, what it points at."""
    own = _column_list(key_columns, NAME, "column_list")
    other = referenced.select(
        *NAME,
        F.col("table_name").alias("referenced_table"),
        F.col("column_name").alias("referenced_column"),
    ).distinct()
    return constraints.join(own, NAME, "left").join(other, NAME, "left")


def column_constraints(
    constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame
) -> DataFrame:
    """Constraints by the column they cover."""
    other = referenced.select(
        *NAME,
        F.col("table_name").alias("referenced_table"),
        F.col("column_name").alias("referenced_column"),
    )
    covered = key_columns.select(*NAME, "column_name")
    return constraints.join(covered, NAME).join(other, NAME, "left")


def foreign_keys(
    constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame
) -> DataFrame:
    """Foreign keys only, with both column lists."""
    own = _column_list(key_columns, NAME, "column_list")
    other = _column_list(
        referenced.withColumnRenamed("table_name", "referenced_table"),
        [*NAME, "referenced_table"],
        "referenced_column_list",
    )
    keys = constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
    return keys.join(own, NAME).join(other, NAME)


def suggested_columns(fields: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Offer each unmapped field the column whose normalised name is the same.

    ``fields`` binding_id, field; ``columns`` binding_id, column_name, position;
    ``mappings`` binding_id, source_field, target_column. The first column of a
    name wins, and a column that is mapped already is not offered.
    """
    taken = mappings.select("binding_id", F.lower("target_column").alias("_column"))
    offered = first_per_key(
        columns.select("binding_id", "column_name", "position").withColumn(
            "_name", normalised_name(F.col("column_name"))
        ),
        ["binding_id", "_name"],
        F.col("position"),
    )
    offered = offered.withColumn("_column", F.lower("column_name")).join(
        taken, ["binding_id", "_column"], "left_anti"
    )
    mapped = (
        mappings.filter(F.col("source_field") != fixed.KEY_MAPPING_FIELD)
        .groupBy("binding_id", F.lower("source_field").alias("_field"))
        .agg(F.min("target_column").alias("mapped_column"))
    )
    offer = F.col("_offer")
    if "field_type" in fields.columns:
        is_own_id = (F.col("field") == "Id") & (F.col("field_type") == "EntityId")
        offer = F.coalesce(offer, F.when(is_own_id, fixed.KEY_COLUMN_SUGGESTION))
    return (
        fields.withColumn("_name", normalised_name(F.col("field")))
        .withColumn("_field", F.lower("field"))
        .join(mapped, ["binding_id", "_field"], "left")
        .join(
            offered.select("binding_id", "_name", F.col("column_name").alias("_offer")),
            ["binding_id", "_name"],
            "left",
        )
        .select(
            "binding_id",
            "field",
            "mapped_column",
            F.when(F.col("mapped_column").isNull(), offer).alias("suggested_column"),
        )
    )


def bound_tables(tables: DataFrame, bindings: DataFrame) -> DataFrame:
    """``full_name, bound_entity``: which entity is bound to each table, if any."""
    bound = (
        bindings.filter(F.trim("target_table") != "")
        .groupBy(F.lower("target_table").alias("_table"))
        .agg(F.min("entity_name").alias("bound_entity"))
    )
    named = tables.withColumn("_table", F.lower("full_name"))
    return named.join(bound, "_table", "left").drop("_table")


def mapped_columns(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Columns with the first field mapped to them, names compared without case."""
    first = (
        mappings.groupBy("binding_id", F.lower("target_column").alias("_column"))
        .agg(F.min_by("source_field", "id").alias("mapped_field"))
    )
    named = columns.withColumn("_column", F.lower("column_name"))
    return named.join(first, ["binding_id", "_column"], "left").drop("_column")
