"""Names of fields, tables, channels and types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.lookup import literal_lookup


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def flattened_name(parent: Column, child: Column) -> Column:
    return F.concat(parent, child)


def normalised_name(name: Column) -> Column:
    """Letters and digits only, lower case, without a trailing ``__c``."""
    base = F.regexp_replace(name, r"(?i)__c\z", "")
    return F.lower(F.regexp_replace(base, r"[^\p{L}\p{Nd}]", ""))


def full_table_name(schema: Column, table: Column) -> Column:
    """``schema.table``; NULL when the table name is blank."""
    owner = F.when(is_blank(schema), F.lit(fixed.DEFAULT_SCHEMA)).otherwise(strip(schema))
    return F.when(~is_blank(table), F.concat(owner, F.lit("."), strip(table)))


def split_table_name(full_name: Column) -> Column:
    """``struct<schema_name, table_name>`` split at the last dot."""
    table = F.substring_index(full_name, ".", -1)
    owner = F.left(full_name, F.length(full_name) - F.length(table) - F.lit(1))
    has_owner = F.length(full_name) > F.length(table) + F.lit(1)
    return F.struct(
        F.when(has_owner, owner).otherwise(F.lit(fixed.DEFAULT_SCHEMA)).alias("schema_name"),
        F.when(has_owner, table).otherwise(full_name).alias("table_name"),
    )


def member_name(channel: Column, entity: Column) -> Column:
    """Full name of a channel member; runs of underscores become one."""
    joined = F.concat(channel, F.lit("_"), entity)
    return F.when(~is_blank(channel) & ~is_blank(entity), F.regexp_replace(joined, "_{2,}", "_"))


def channel_name(developer_name: Column, prefix: Column) -> Column:
    head = F.when(is_blank(prefix), F.lit("")).otherwise(F.concat(prefix, F.lit("__")))
    return F.concat(head, developer_name, F.lit(fixed.CHANNEL_SUFFIX))


def is_change_entity(entity: Column) -> Column:
    return entity.endswith(fixed.CHANGE_ENTITY_SUFFIX)


def is_channel_name(full_name: Column) -> Column:
    """Ends with the channel suffix and the rest is a valid developer name."""
    rest = F.left(full_name, F.length(full_name) - F.lit(len(fixed.CHANNEL_SUFFIX)))
    valid = rest.rlike(r"^[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)*\z")
    return F.coalesce(full_name.endswith(fixed.CHANNEL_SUFFIX) & valid, F.lit(False))


def entity_fits_channel(entity: Column, channel_type: Column) -> Column:
    """A data channel carries change entities only, an event channel none."""
    kind = F.lower(channel_type)
    return (
        F.when(kind == "data", is_change_entity(entity))
        .when(kind == "event", ~is_change_entity(entity))
        .otherwise(F.lit(True))
    )


def _one_of(text: Column, allowed: list[str]) -> Column:
    value = F.lower(strip(text))
    return F.when(value.isin(allowed), value)


def channel_type(text: Column) -> Column:
    """Normalised channel type, NULL when it is none of the known ones."""
    return _one_of(text, fixed.CHANNEL_TYPES)


def event_type(text: Column) -> Column:
    """``struct<value, valid>``: a blank event type is valid and NULL."""
    value = _one_of(text, fixed.EVENT_TYPES)
    return F.struct(value.alias("value"), (is_blank(text) | value.isNotNull()).alias("valid"))


def is_record_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[a-z\d]{18}\z"), F.lit(False))


def column_family(data_type: Column, dialect: str = "postgres") -> Column:
    """Family of a target type name, its declared size ignored."""
    name = F.lower(strip(data_type))
    name = F.when(F.instr(name, "(") > 1, strip(F.substring_index(name, "(", 1))).otherwise(name)
    families = {t: f for f, names in fixed.FAMILY_TYPE_NAMES.items() for t in names}
    if dialect == "sqlserver":
        families["bit"] = "Boolean"
    return F.coalesce(literal_lookup(families, name), F.lit("Unknown"))


def json_names(encoded: Column) -> Column:
    """Decode a JSON string array, blanks dropped and the rest trimmed."""
    names = F.from_json(encoded, "array<string>")
    return F.transform(F.filter(names, lambda n: ~is_blank(n)), strip)


def json_encode_names(names: Column) -> Column:
    """Encode names as a JSON array without blanks; NULL when none is left."""
    kept = F.filter(names, lambda n: ~is_blank(n))
    return F.when(F.size(kept) > 0, F.to_json(kept))
