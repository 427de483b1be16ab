"""Route events to bindings by the schema id they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.plans.config import is_active
from tidemark.sizing import broadcast_if_small

# Outcomes of an event, from routing to application.
APPLIED = "applied"
NO_SCHEMA = "no schema"
BY_NAME = "by name"
NO_BINDING = "no binding"
INACTIVE = "inactive"
BAD_PAYLOAD = "bad payload"
BAD_HEADER = "bad header"
UNKNOWN_KIND = "unknown type"
UNSUPPORTED_KIND = "unsupported type"
BAD_BITMAP = "bad bitmap"
BAD_VALUE = "bad value"
UNDELETE_SKIPPED = "undelete skipped"
NO_CHANGE = "no change"
NO_KEY_MAPPING = "no key mapping"
BAD_MAPPING = "bad mapping"

# Outcomes of a change at its table.
REFUSED = "refused"
NO_ROW = "no row"
LATE = "late"
NO_KEY = "no key"
NO_ORDER = "no order"


def route(events: DataFrame, plan: DataFrame, registry: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add ``binding_id`` and ``route``: direct, by name, or why there is none.

    An event whose schema id is in the plan belongs to that binding. Any other
    goes by the record name of its revision, whether or not that entity is on
    the channel, and only an active binding takes it.
    """
    # One small table answers for every schema id, so events are joined once.
    known = registry.groupBy("schema_id").agg(F.max("record_name").alias("record_name"))
    direct = plan.groupBy("schema_id").agg(F.max("id").alias("_direct"))
    named = bindings.groupBy(F.col("entity_name").alias("record_name")).agg(
        F.max("id").alias("_named"), F.max_by("state", "id").alias("_state")
    )
    targets = known.join(direct, "schema_id", "full").join(named, "record_name", "left")
    reason = (
        F.when(F.col("_direct").isNotNull(), "direct")
        .when(F.col("_named").isNull(), NO_BINDING)
        .when(~is_active(F.col("_state")), INACTIVE)
        .otherwise(BY_NAME)
    )
    taken = reason.isin("direct", BY_NAME)
    targets = targets.select(
        "schema_id",
        F.when(taken, F.coalesce("_direct", "_named")).alias("binding_id"),
        reason.alias("route"),
    )
    routed = events.join(broadcast_if_small(targets, bound=registry), "schema_id", "left")
    return routed.withColumn("route", F.coalesce("route", F.lit(NO_SCHEMA)))


def current_revisions(plan: DataFrame, order: Column) -> DataFrame:
    """One schema id per entity: the newest, older ones being superseded."""
    return plan.groupBy("entity_name").agg(F.max_by("schema_id", order).alias("schema_id"))


def kind_outcome(kind: Column, soft: Column) -> Column:
    """Why a change type is not applied; NULL when it is."""
    return (
        F.when(kind.isNull(), BAD_HEADER)
        .when(kind.isin(fixed.GAP_KINDS), UNSUPPORTED_KIND)
        .when(~kind.isin(fixed.APPLIED_KINDS), UNKNOWN_KIND)
        .when((kind == "UNDELETE") & ~soft, UNDELETE_SKIPPED)
    )


def effective_kind(kind: Column, soft: Column) -> Column:
    """What an event does to its table: insert, update, delete, mark or restore."""
    return (
        F.when(kind == "CREATE", "insert")
        .when(kind == "UPDATE", "update")
        .when(kind == "DELETE", F.when(soft, "mark").otherwise("delete"))
        .when((kind == "UNDELETE") & soft, "restore")
    )


def marks_deleted(enabled: Column, flag_column: Column) -> Column:
    """Soft delete needs both the switch and a column for the flag."""
    named = flag_column.isNotNull() & (F.trim(flag_column) != "")
    return F.coalesce(enabled, F.lit(False)) & named
