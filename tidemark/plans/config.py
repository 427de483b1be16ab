"""Configuration tables: schema registry, bindings, mappings, channels.

``registry``  id, schema_id, record_name, schema_json, date_created
``bindings``  id, avro_schema_id, entity_name, target_table, state,
              soft_delete_enabled, soft_delete_column
``mappings``  id, binding_id, source_field, target_column
``channels``  id, full_name, is_primary
``members``   channel_id, selected_entity

They describe the feeds and stay small beside them, but nothing here relies on
that: every operator is an equi-join or a mergeable aggregate, and Spark picks
the broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.names import is_blank, is_change_entity
from tidemark.operators.mirror import newest_per_key


def latest_revisions(registry: DataFrame) -> DataFrame:
    """Newest registry row of each record name."""
    return newest_per_key(registry, ["record_name"], F.struct("date_created", "id"))


def revision(registry: DataFrame, schema_id: str) -> DataFrame:
    return registry.filter(F.col("schema_id") == schema_id)


def registry_by_age(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("date_created"), F.desc("id"))


def register(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Registry plus the revisions in ``seen`` that it does not hold yet."""
    rest = [c for c in seen.columns if c != "schema_id"]
    one = seen.groupBy("schema_id").agg(F.min(F.struct(*rest)).alias("_r"))
    fresh = one.select("schema_id", "_r.*").join(
        registry.select("schema_id"), "schema_id", "left_anti"
    )
    return registry.unionByName(fresh, allowMissingColumns=True)


def bound_revisions(bindings: DataFrame, registry: DataFrame) -> DataFrame:
    """Bindings with the schema revision they are linked to, where they have one."""
    linked = registry.select(
        F.col("id").alias("avro_schema_id"), "schema_id", "record_name", "schema_json"
    )
    return bindings.join(linked, "avro_schema_id", "left")


def field_maps(mappings: DataFrame) -> DataFrame:
    """``binding_id, fields``: map from source field to target column.

    One entry per field and binding; a binding cannot have more fields than its
    schema, so the maps are bounded by the schema's width.
    """
    one = mappings.groupBy("binding_id", "source_field").agg(
        F.max_by("target_column", "id").alias("target_column")
    )
    pairs = F.collect_list(F.struct("source_field", "target_column"))
    return one.groupBy("binding_id").agg(F.map_from_entries(F.array_sort(pairs)).alias("fields"))


def mapping_summary(mappings: DataFrame) -> DataFrame:
    """Key column and number of field mappings per binding."""
    is_key = F.col("source_field") == fixed.KEY_MAPPING_FIELD
    return mappings.groupBy("binding_id").agg(
        F.max(F.when(is_key, F.col("target_column"))).alias("key_column"),
        F.count_if(~is_key).alias("field_mappings"),
    )


def primary_channel(channels: DataFrame) -> DataFrame:
    return channels.filter("is_primary").orderBy("id").limit(1)


def is_active(state: Column) -> Column:
    return F.coalesce(state == "Active", F.lit(False))


def backfilled_state(state: Column, target_table: Column) -> Column:
    """State of bindings from before states existed."""
    unset = F.when(target_table.isNull() | (target_table == ""), "Incomplete").otherwise("Active")
    return F.when(state == "Incomplete", unset).otherwise(state)


def subscription_plan(
    bindings: DataFrame, registry: DataFrame, channels: DataFrame, members: DataFrame
) -> DataFrame:
    """Active bindings of the primary channel's entities, one per schema id."""
    primary = members.join(
        primary_channel(channels).select(F.col("id").alias("channel_id")), "channel_id"
    )
    entities = primary.select(F.lower("selected_entity").alias("_entity")).distinct()
    active = bound_revisions(bindings, registry).filter(
        is_active(F.col("state")) & F.col("schema_id").isNotNull()
    )
    listed = active.withColumn("_entity", F.lower("entity_name")).join(
        entities, "_entity", "left_semi"
    )
    return listed.drop("_entity")


def in_force(versions: DataFrame, key: list[str], since: str) -> DataFrame:
    """Versions of configuration rows with ``until``, where the next of their key begins; NULL for the
    last. Of versions of one key that begin together the one that is greatest in its other
    columns holds. A key has as many rows as it was changed, so the window is over few.
    """
    others = [c for c in versions.columns if c not in (*key, since)]
    one = versions.filter(F.col(since).isNotNull()).groupBy(*key, since).agg(F.max(F.struct(*others)).alias("_v"))
    after = Window.partitionBy(*key).orderBy(since)
    return one.select(*key, since, F.lead(since).over(after).alias("until"), "_v.*")


def as_of(events: DataFrame, versions: DataFrame, key: list[str], since: str, at: Column) -> DataFrame:
    """Events with the version of their key that is in force ``at`` their time or position; those
    before the first version, or of a key without one, are left with NULLs.

    What holds for an event follows from the event, whichever batch it comes in, so a batch
    that runs again after a change of configuration gives the same rows. An equi-join on the
    key with the range as its condition: an event meets one version.
    """
    held = in_force(versions, key, since)
    renamed = held.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in held.columns if c not in key])
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    on = same[0]
    for more in same[1:]:
        on = on & more
    on = on & (at >= F.col(since)) & (F.col("until").isNull() | (at < F.col("until")))
    return events.join(renamed, on, "left").drop("until", *[f"_{k}" for k in key])


def newest_named(registry: DataFrame, events: DataFrame, order: Column) -> DataFrame:
    """``entity_name, revision, at``: the revision that the last event of each entity names."""
    named = registry.select(
        "schema_id", F.col("record_name").alias("entity_name"), F.col("id").alias("_revision")
    )
    # Reduce the events to one row per schema id before they meet the registry.
    last_seen = events.groupBy("schema_id").agg(F.max(order).alias("_at"))
    return (
        last_seen.join(named, "schema_id")
        .groupBy("entity_name")
        .agg(F.max_by("_revision", "_at").alias("revision"), F.max("_at").alias("at"))
    )


def relink(bindings: DataFrame, registry: DataFrame, events: DataFrame, order: Column) -> DataFrame:
    """Link each binding to the newest revision its entity's events have named."""
    newest = newest_named(registry, events, order)
    joined = bindings.join(newest, "entity_name", "left")
    linked = F.coalesce("revision", "avro_schema_id")
    return joined.withColumn("avro_schema_id", linked).select(*bindings.columns)


def selectable_entities(entities: DataFrame, channel_type: str | None = None) -> DataFrame:
    """Entities that may join a channel: ``value, label``, in binary order."""
    value = F.col("value")
    usable = F.col("active") & ~is_blank(value) & ~value.rlike(r"^\p{Nd}")
    if channel_type is not None and channel_type.lower() in fixed.CHANNEL_TYPES:
        wanted = is_change_entity(value)
        usable = usable & (wanted if channel_type.lower() == "data" else ~wanted)
    label = F.when(is_blank(F.col("label")), value).otherwise(F.col("label"))
    return entities.filter(usable).select(value, label.alias("label")).orderBy("value")
