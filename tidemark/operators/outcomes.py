"""Counts over processed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("events"))


def changed_frequency(events: DataFrame, entity: Column, names: Column) -> DataFrame:
    """How often each field changed, per entity."""
    return (
        events.select(entity.alias("entity"), F.explode(names).alias("field"))
        .groupBy("entity", "field")
        .agg(F.count("*").alias("changes"))
    )


def unmapped_fields(frequency: DataFrame, mappings: DataFrame) -> DataFrame:
    """Changed fields without a mapping; ``mappings`` has ``entity, field``."""
    return frequency.join(mappings.select("entity", "field"), ["entity", "field"], "left_anti")


def latest_position(events: DataFrame, position: Column, by: list[str] | None = None) -> DataFrame:
    return events.groupBy(*(by or [])).agg(F.max(position).alias("latest_position"))
