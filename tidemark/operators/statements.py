"""Single statements on a keyed table: insert, update, delete, mark, restore.

Each takes the table and the rows or ids of one statement and returns the table
afterwards. Ids may repeat; they are reduced to distinct ones before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.convert import flag_value


def accepted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of ``rows`` those that can be inserted: of a new key the least row, by its columns in
    their order; one of a taken key never.
    """
    others = [c for c in rows.columns if c != key]
    fresh = rows.join(table.select(key), key, "left_anti")
    least = fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")) if others else fresh.distinct()
    return least.select(*[F.col(f"_row.{c}").alias(c) if c in others else key for c in rows.columns])


def insert_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key is new; rows with a taken key are refused, and so are further
    rows of the same new key.
    """
    return table.unionByName(accepted(table, rows, key), allowMissingColumns=True)


def refused_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows ``insert_rows`` refuses."""
    return rows.exceptAll(accepted(table, rows, key))


def update_columns(
    table: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]
) -> DataFrame:
    """Set ``values`` where the key is among ``ids``; other rows stay as they are.

    A value may use the table's columns and those ``ids`` brings along, one row
    per id in that case.
    """
    keyed = ids if len(ids.columns) > 1 else ids.distinct()
    hit = keyed.withColumnRenamed(key, "_id").withColumn("_hit", F.lit(True))
    joined = table.join(hit, table[key] == hit["_id"], "left")
    return joined.select(*[
        F.when(F.col("_hit"), values[c]).otherwise(table[c]).alias(c) if c in values else table[c]
        for c in table.columns
    ])


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def set_flag(
    table: DataFrame, ids: DataFrame, key: str, flag: str, deleted: bool, family: str = "Boolean"
) -> DataFrame:
    """Mark (``deleted``) or restore rows, as 0 and 1 in an integer column."""
    return update_columns(table, ids.select(key), key, {flag: flag_value(F.lit(deleted), family)})


def affected(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows a statement on ``ids`` touches, one row ``(affected)``."""
    return table.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("affected"))
