"""Semantic field types: read from a field's documentation or its wire type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.lookup import literal_lookup
from tidemark.functions.names import is_blank, strip

TYPE_CLASSES = {
    **{t: "textual" for t in fixed.TEXT_TYPES},
    **{t: "boolean" for t in fixed.BOOLEAN_TYPES},
    **{t: "numeric" for t in fixed.NUMERIC_TYPES},
    **{t: "temporal" for t in fixed.TEMPORAL_TYPES},
    **{t: "compound" for t in fixed.COMPOUND_TYPES},
}

WIRE_TYPES = {
    "string": "Text",
    "boolean": "Boolean",
    "int": "Integer",
    "long": "Integer",
    "float": "Double",
    "double": "Double",
}


def parse_doc(doc: Column) -> Column:
    """``role:type[:field id]`` as ``struct<role, raw_type, field_type, field_id>``.

    A text without a colon is a type without a role. A type nobody knows is
    ``Unknown`` with its text kept in ``raw_type``.
    """
    parts = F.split(doc, ":")
    has_role = F.size(parts) > 1
    role = F.when(has_role, strip(F.get(parts, F.lit(0)))).otherwise(F.lit(""))
    raw = strip(F.when(has_role, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))
    third = F.get(parts, F.lit(2))
    bare = F.lower(F.regexp_replace(raw, "(?i)^" + fixed.SWITCHABLE_PREFIX, ""))
    known = literal_lookup({t.lower(): t for t in TYPE_CLASSES}, bare)
    empty = is_blank(doc)
    return F.struct(
        F.when(empty, F.lit("")).otherwise(role).alias("role"),
        F.when(empty, F.lit("")).otherwise(raw).alias("raw_type"),
        F.when(empty, F.lit(fixed.UNKNOWN_TYPE))
        .otherwise(F.coalesce(known, F.lit(fixed.UNKNOWN_TYPE)))
        .alias("field_type"),
        F.when(~empty & ~is_blank(third), strip(third)).alias("field_id"),
    )


def type_class(field_type: Column) -> Column:
    """temporal, numeric, boolean, compound, textual or unknown."""
    return F.coalesce(literal_lookup(TYPE_CLASSES, field_type), F.lit("unknown"))


def type_of_wire(wire_type: Column) -> Column:
    return F.coalesce(literal_lookup(WIRE_TYPES, wire_type), F.lit(fixed.UNKNOWN_TYPE))


def scalar_type(doc: Column, wire_type: Column) -> Column:
    """Type of a top-level scalar: a doc that describes a compound does not describe it."""
    documented = parse_doc(doc)["field_type"]
    return F.when(type_class(documented) == "compound", type_of_wire(wire_type)).otherwise(documented)


def child_type(doc: Column, wire_type: Column) -> Column:
    """Type of a compound's child: by wire type unless its own doc says more."""
    documented = parse_doc(doc)["field_type"]
    return F.when(documented == fixed.UNKNOWN_TYPE, type_of_wire(wire_type)).otherwise(documented)
