"""Does a mapping fit its target? Checked on declared types and on the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.docs import type_class
from tidemark.functions.lookup import literal_lookup
from tidemark.functions.names import column_family

OK, WARNING, ERROR = "Compatible", "Warning", "Error"

# What each kind of field does in each column family; families not listed refuse it.
FITS = {
    "DateTime": {"Timestamp": (OK, "fits"), "Date": (WARNING, "drops time"),
                 "Text": (OK, "stored as text")},
    "DateOnly": {"Timestamp": (OK, "fits"), "Date": (OK, "fits"), "Text": (OK, "stored as text")},
    "TimeOnly": {"Time": (OK, "fits"), "Text": (OK, "stored as text")},
    "whole": {"Integer": (OK, "fits"), "Decimal": (OK, "fits"),
              "Text": (WARNING, "number as text")},
    "fraction": {"Integer": (WARNING, "drops fraction"), "Decimal": (OK, "fits"),
                 "Text": (WARNING, "number as text")},
    "boolean": {"Boolean": (OK, "fits"), "Integer": (WARNING, "stored as 0 and 1"),
                "Text": (WARNING, "stored as words")},
    "textual": {"Text": (OK, "fits")},
}


def _verdict(level: str, reason: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))


def fit(
    field_type: Column, family: Column, max_length: Column, dialect: str = "postgres"
) -> Column:
    """``struct<level, reason>`` of writing a semantic type into a column family."""
    kind = type_class(field_type)
    row = (
        F.when(kind == "temporal", field_type)
        .when(field_type == "Integer", "whole")
        .when(kind == "numeric", "fraction")
        .otherwise(kind)
    )
    cells = {
        f"{r}/{f}": _verdict(*verdict) for r, cols in FITS.items() for f, verdict in cols.items()
    }
    entries = [part for cell, verdict in cells.items() for part in (F.lit(cell), verdict)]
    listed = F.try_element_at(F.create_map(*entries), F.concat_ws("/", row, family))
    longest = literal_lookup(fixed.STANDARD_MAX_LENGTHS, field_type)
    shorter = (kind == "textual") & (family == "Text") & (max_length < longest)
    stored_number = (
        (kind == "temporal") & (family == "Integer") if dialect == "sqlite" else F.lit(False)
    )
    return (
        F.when(kind == "compound", _verdict(ERROR, "compound"))
        .when(kind == "unknown", _verdict(WARNING, "unknown type"))
        .when(family == "Unknown", _verdict(WARNING, "unknown column type"))
        .when(stored_number, _verdict(WARNING, "stored as number"))
        .when(F.coalesce(shorter, F.lit(False)), _verdict(WARNING, "may truncate"))
        .otherwise(F.coalesce(listed, _verdict(ERROR, "does not fit")))
    )


def key_fit(family: Column, max_length: Column, is_unique: Column) -> Column:
    """A key column holds whole record ids and should be unique."""
    short = F.coalesce(max_length < fixed.RECORD_ID_LENGTH, F.lit(False))
    return (
        F.when(family != "Text", _verdict(ERROR, "key not text"))
        .when(short, _verdict(ERROR, "key too short"))
        .when(~F.coalesce(is_unique, F.lit(False)), _verdict(WARNING, "key not unique"))
        .otherwise(_verdict(OK, "fits"))
    )


def flag_fit(family: Column) -> Column:
    return (
        F.when(family == "Boolean", _verdict(OK, "fits"))
        .when(family == "Integer", _verdict(WARNING, "stored as 0 and 1"))
        .otherwise(_verdict(ERROR, "flag not boolean"))
    )


# Checks on a set of mappings.


def mapping_set_problems(
    mappings: DataFrame, fields: DataFrame, columns: DataFrame, keys: DataFrame
) -> DataFrame:
    """Problems that refuse a proposed mapping set, one row per problem.

    ``mappings`` binding_id, source_field, target_column; ``fields`` binding_id,
    field; ``columns`` binding_id, column_name; ``keys`` binding_id, key_column.
    """
    named = mappings.select(
        "binding_id", "source_field", "target_column",
        F.lower("source_field").alias("_field"), F.lower("target_column").alias("_column"),
    )
    known_fields = fields.select("binding_id", F.lower("field").alias("_field")).distinct()
    known_columns = columns.select("binding_id", F.lower("column_name").alias("_column")).distinct()
    key_columns = keys.select("binding_id", F.lower("key_column").alias("_column")).distinct()
    on_field, on_column = ["binding_id", "_field"], ["binding_id", "_column"]

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("binding_id", "source_field", "target_column",
                           F.lit(name).alias("problem"))

    twice = (
        named.groupBy(*on_column).agg(F.count("*").alias("n"), F.min("target_column").alias("c"))
        .filter("n > 1")
        .select("binding_id", F.lit(None).cast("string").alias("source_field"),
                F.col("c").alias("target_column"), F.lit("column mapped twice").alias("problem"))
    )
    return (
        problem(named.join(known_fields, on_field, "left_anti"), "unknown field")
        .unionByName(problem(named.join(known_columns, on_column, "left_anti"), "unknown column"))
        .unionByName(problem(named.join(key_columns, on_column, "left_semi"), "holds the record id"))
        .unionByName(twice)
    )


def check_mappings(
    mappings: DataFrame, fields: DataFrame, columns: DataFrame, dialect: str = "postgres"
) -> DataFrame:
    """Verdict on every mapping: missing column, missing field, or fit of the two.

    ``fields`` binding_id, field, field_type; ``columns`` binding_id, column_name,
    data_type, max_length, is_unique. The key mapping is judged as a key.
    """
    of_field = fields.select("binding_id", F.lower("field").alias("_field"), "field_type")
    of_column = columns.select(
        "binding_id", F.lower("column_name").alias("_column"), "data_type", "max_length", "is_unique"
    )
    is_key = F.col("source_field") == fixed.KEY_MAPPING_FIELD
    family = F.col("_family")
    verdict = (
        F.when(F.col("data_type").isNull(), _verdict("Blocker", "no such column"))
        .when(is_key, key_fit(family, F.col("max_length"), F.col("is_unique")))
        .when(F.col("field_type").isNull(), _verdict("Blocker", "no such field"))
        .otherwise(fit(F.col("field_type"), family, F.col("max_length"), dialect))
    )
    return (
        mappings.withColumn("_field", F.lower("source_field"))
        .withColumn("_column", F.lower("target_column"))
        .join(of_column, ["binding_id", "_column"], "left")
        .join(of_field, ["binding_id", "_field"], "left")
        .withColumn("_family", column_family(F.col("data_type"), dialect))
        .select("binding_id", "source_field", "target_column", verdict.alias("_v"))
        .select("binding_id", "source_field", "target_column", "_v.level", "_v.reason")
    )


def unwritten_required(columns: DataFrame, mappings: DataFrame, flags: DataFrame) -> DataFrame:
    """NOT NULL columns without default that neither a mapping nor the flag writes."""
    written = mappings.select("binding_id", F.lower("target_column").alias("_column")).unionByName(
        flags.select("binding_id", F.lower("soft_delete_column").alias("_column"))
    )
    required = columns.filter(~F.col("nullable") & F.col("default_value").isNull())
    return (
        required.withColumn("_column", F.lower("column_name"))
        .join(written, ["binding_id", "_column"], "left_anti")
        .select("binding_id", "column_name")
    )


def validation_items(
    bindings: DataFrame,
    mappings: DataFrame,
    fields: DataFrame,
    columns: DataFrame,
    dialect: str = "postgres",
) -> DataFrame:
    """Every finding about every binding: ``binding_id, item, level, reason``.

    ``bindings`` binding_id, schema_id, soft_delete_enabled, soft_delete_column.
    Findings stay rows, so a binding with many of them needs no single task.
    """
    tables = columns.select("binding_id").distinct()
    bound = bindings.join(tables.withColumn("_table", F.lit(True)), "binding_id", "left")

    def item(rows: DataFrame, name: Column, level: str, reason: str) -> DataFrame:
        return rows.select("binding_id", name.alias("item"), F.lit(level).alias("level"),
                           F.lit(reason).alias("reason"))

    no_table = bound.filter(F.col("_table").isNull())
    no_schema = bound.filter(F.col("_table").isNotNull() & F.col("schema_id").isNull())
    checked = bound.filter(F.col("_table").isNotNull() & F.col("schema_id").isNotNull())
    checked = checked.select("binding_id", "soft_delete_enabled", "soft_delete_column")

    is_key = F.col("source_field") == fixed.KEY_MAPPING_FIELD
    counts = mappings.groupBy("binding_id").agg(
        F.count_if(is_key).alias("_keys"), F.count_if(~is_key).alias("_fields")
    )
    counted = checked.join(counts, "binding_id", "left").fillna(0, ["_keys", "_fields"])
    none = F.lit("")
    verdicts = check_mappings(mappings, fields, columns, dialect).join(
        checked.select("binding_id"), "binding_id", "left_semi"
    )
    unwritten = unwritten_required(columns, mappings, bindings).join(
        checked.select("binding_id"), "binding_id", "left_semi"
    )
    family = column_family(F.col("data_type"), dialect)
    named = F.coalesce(F.trim("soft_delete_column") != "", F.lit(False))
    flag_verdict = (
        F.when(~named, _verdict("Blocker", "no flag column"))
        .when(F.col("data_type").isNull(), _verdict("Blocker", "no such flag column"))
        .otherwise(flag_fit(family))
    )
    flags = (
        checked.filter("soft_delete_enabled")
        .withColumn("_column", F.lower("soft_delete_column"))
        .join(
            columns.select("binding_id", F.lower("column_name").alias("_column"), "data_type"),
            ["binding_id", "_column"],
            "left",
        )
        .select("binding_id", F.coalesce("soft_delete_column", none).alias("item"),
                flag_verdict.alias("_v"))
        .select("binding_id", "item", "_v.level", "_v.reason")
    )
    return (
        item(no_table, none, "Blocker", "no target table")
        .unionByName(item(no_schema, none, "Blocker", "no schema"))
        .unionByName(item(counted.filter("_keys = 0"), none, "Blocker", "no key mapping"))
        .unionByName(item(counted.filter("_fields = 0"), none, "Blocker", "no field mapping"))
        .unionByName(verdicts.select("binding_id", F.col("target_column").alias("item"),
                                     "level", "reason"))
        .unionByName(item(unwritten, F.col("column_name"), WARNING, "required but unwritten"))
        .unionByName(flags)
    )


def validation_report(bindings: DataFrame, items: DataFrame) -> DataFrame:
    """One row per binding: findings by level and whether it can be activated."""
    counts = items.groupBy("binding_id").agg(
        *[F.count_if(F.col("level") == level).alias(name) for level, name in (
            ("Blocker", "blockers"), (ERROR, "errors"), (WARNING, "warnings"), (OK, "compatible"))]
    )
    names = ["blockers", "errors", "warnings", "compatible"]
    report = bindings.select("binding_id", "schema_id").join(counts, "binding_id", "left")
    report = report.fillna(0, names)
    return report.withColumn("can_activate", (F.col("blockers") == 0) & (F.col("errors") == 0))


def state_after_edit(state: Column, can_activate: Column) -> Column:
    """An active binding that no longer validates is switched off."""
    return F.when((state == "Active") & ~can_activate, "Inactive").otherwise(state)


# The same questions asked of the data.


def text_overflow(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per text column: how many values exceed the declared length, and the longest."""
    measures = []
    for c, limit in limits.items():
        length = F.length(c)
        measures += [F.count_if(length > limit).alias(f"{c}_over"), F.max(length).cast("bigint").alias(f"{c}_max")]
    return rows.agg(*measures)


def precision_loss(rows: DataFrame, fractions: list[str], times: list[str]) -> DataFrame:
    """Values that lose a fraction in an integer column or a time in a date column."""
    cut = [F.count_if(F.col(c) != F.floor(c)).alias(f"{c}_fraction") for c in fractions]
    cut += [F.count_if(F.col(c) != F.date_trunc("day", F.col(c))).alias(f"{c}_time") for c in times]
    return rows.agg(*cut)


def missing_required(rows: DataFrame, required: list[str]) -> DataFrame:
    """Per required column: rows whose insert would fail for want of a value."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in required])


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_parents(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Foreign key values without a parent, with how many rows carry each."""
    counts = rows.filter(F.col(foreign).isNotNull()).groupBy(foreign).agg(F.count("*").alias("n"))
    return counts.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def shared_destinations(bindings: DataFrame, name: str) -> DataFrame:
    """Entities or tables that more than one binding claims; blank ones are not claimed yet."""
    return (
        bindings.filter(F.trim(name) != "")
        .groupBy(F.lower(name).alias(name))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
