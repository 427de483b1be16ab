"""The fields of many schema revisions as rows, read by Spark from their texts.

What ``schema.entity_fields`` says of one revision on the driver, this says of a whole
registry: texts become variants, and unions, compounds and their children are exploded.
Types that a schema names instead of repeating them are joined from where it defines them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.docs import child_type, parse_doc, scalar_type
from tidemark.plans.schema import PRIMITIVES
from tidemark.session import staged

OWN_KINDS = ("record", "enum", "array")
ROW = ["schema_id", "name", "field_type", "wire_type", "nullable", "parent_position", "position",
       "parent", "child", "field_id"]


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def is_kind(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def unwrapped(value: Column) -> Column:
    """``{"type": {...}}`` and ``{"type": [...]}`` as what they hold."""
    inner = F.try_variant_get(value, "$.type", "variant")
    return F.when(is_kind(value, "OBJECT") & ~is_kind(inner, "STRING"), inner).otherwise(value)


def members(value: Column) -> Column:
    """The types of a union, or the one type as an array."""
    value = unwrapped(unwrapped(value))
    union = F.try_variant_get(value, "$", "array<variant>")
    return F.when(is_kind(value, "ARRAY"), F.transform(union, lambda m: unwrapped(unwrapped(m)))).otherwise(F.array(value))


def kind_of(member: Column) -> Column:
    """The kind of a type, or the name of one defined elsewhere."""
    return F.when(is_kind(member, "STRING"), text_at(member, "$")).otherwise(text_at(member, "$.type"))


def full_name(name: Column, namespace: Column) -> Column:
    bare = name.contains(".") | F.coalesce(namespace == "", F.lit(True))
    return F.when(bare, name).otherwise(F.concat(namespace, F.lit("."), name))


def exploded(rows: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """One row per type of a field: its number, kind, whether null is among the types, and, for
    types defined here, full name and children. ``ref`` names a type defined elsewhere.
    """
    listed = rows.select(*keep, "namespace", members(F.col(value)).alias("_members"))
    nullable = F.exists("_members", lambda m: F.coalesce(kind_of(m) == "null", F.lit(False)))
    one = listed.select(*keep, "namespace", nullable.alias("nullable"), F.posexplode("_members").alias("at", "_m"))
    kind, inner = kind_of(F.col("_m")), F.coalesce(text_at(F.col("_m"), "$.namespace"), F.col("namespace"))
    named = is_kind(F.col("_m"), "STRING") & ~kind.isin(*PRIMITIVES)
    defined = ~is_kind(F.col("_m"), "STRING") & kind.isin("record", "enum")
    return one.select(
        *keep, "nullable", "at", F.when(~named, kind).alias("kind"),
        F.when(named, full_name(kind, F.col("namespace"))).alias("ref"),
        F.when(defined, full_name(text_at(F.col("_m"), "$.name"), inner)).alias("defines"),
        inner.alias("namespace"), F.try_variant_get("_m", "$.fields", "array<variant>").alias("fields"))


def fields_in(rows: DataFrame, keep: list[str], at: str) -> DataFrame:
    """One row per field of records in ``fields``: its place, name, doc and type."""
    one = rows.select(*keep, "namespace", F.posexplode("fields").alias(at, "_f"))
    return one.select(*keep, "namespace", at, text_at(F.col("_f"), "$.name").alias(f"{at}_name"),
                      text_at(F.col("_f"), "$.doc").alias(f"{at}_doc"), F.try_variant_get("_f", "$.type", "variant").alias("type"))


def resolved(types: DataFrame, definitions: DataFrame) -> DataFrame:
    """``types`` with kind and children of those defined elsewhere in the same schema."""
    known = definitions.select("schema_id", F.col("defines").alias("ref"), F.col("kind").alias("_kind"),
                               F.col("fields").alias("_fields"), F.col("namespace").alias("_namespace"))
    joined = types.join(known, ["schema_id", "ref"], "left")
    return joined.withColumns({
        "kind": F.coalesce("kind", "_kind"), "fields": F.coalesce("fields", "_fields"),
        "namespace": F.coalesce("_namespace", "namespace")}).drop("_kind", "_fields", "_namespace", "defines")


def parsed(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types of the fields of every revision, and of the children of its compounds, resolved."""
    schemas = registry.select("schema_id", F.try_parse_json("schema_json").alias("_s"))
    schemas = schemas.select("schema_id", F.coalesce(text_at(F.col("_s"), "$.namespace"), F.lit("")).alias("namespace"),
                             F.try_variant_get("_s", "$.fields", "array<variant>").alias("fields"))
    tops = fields_in(schemas, ["schema_id"], "position")
    keep = ["schema_id", "position", "position_name", "position_doc"]
    types = exploded(tops, "type", keep)
    # A child may name a type too, and define one that later fields name.
    inner_fields = fields_in(types.filter("defines IS NOT NULL AND kind = 'record'"), ["schema_id"], "child")
    inner = exploded(inner_fields, "type", ["schema_id"])
    shape = ["schema_id", "defines", "kind", "fields", "namespace"]
    definitions = types.filter("defines IS NOT NULL").select(*shape).unionByName(
        inner.filter("defines IS NOT NULL").select(*shape))
    types = resolved(types, definitions)
    shown = ["kind", "nullable", "at"]
    child_fields = fields_in(types.filter("kind = 'record'"), [*keep, "nullable"], "child")
    child_keep = [*keep, "child", "child_name", "child_doc"]
    children = resolved(exploded(child_fields.drop("nullable"), "type", child_keep), definitions)
    return types.select(*keep, *shown), children.select(*child_keep, *shown)


def unreadable(registry: DataFrame) -> DataFrame:
    """``schema_id, problem`` of revisions whose text is no schema of change events."""
    return problems(registry, *parsed(registry))


def problems(registry: DataFrame, types: DataFrame, children: DataFrame) -> DataFrame:
    schema = F.try_parse_json("schema_json")
    is_record = (text_at(schema, "$.type") == "record") & is_kind(F.try_variant_get(schema, "$.fields", "variant"), "ARRAY")
    broken = registry.select("schema_id", F.when(schema.isNull(), "no JSON").when(
        ~F.coalesce(is_record, F.lit(False)), "no record").alias("problem")).filter("problem IS NOT NULL")
    kinds = types.select("schema_id", "kind").unionByName(children.select("schema_id", "kind"))
    odd = kinds.filter(F.col("kind").isNull() | ~F.col("kind").isin(*PRIMITIVES, *OWN_KINDS))
    odd = odd.select("schema_id").distinct().join(broken, "schema_id", "left_anti")
    return broken.unionByName(odd.withColumn("problem", F.lit("unsupported type")))


def entity_field_rows(registry: DataFrame) -> DataFrame:
    """Every field of every revision in ``registry`` (schema_id, schema_json) that can be mapped:
    the header left out, compounds by their children. Revisions that are ``unreadable`` have none.

    A compound's child counts with the first of its types that is no record.
    """
    # Texts are the long part; what is read from them feeds several joins.
    types, children = (staged(rows, name) for rows, name in zip(parsed(registry), ("types", "children"), strict=True))
    entity = F.col("position_name") != fixed.HEADER_FIELD
    field_id = parse_doc(F.col("position_doc"))["field_id"].alias("field_id")
    none = F.lit(None).cast("string")
    scalars = types.filter(entity & ~F.col("kind").isin("null", "record")).select(
        "schema_id", F.col("position_name").alias("name"),
        scalar_type(F.col("position_doc"), F.col("kind")).alias("field_type"), F.col("kind").alias("wire_type"),
        "nullable", F.lit(-1).alias("parent_position"), "position", none.alias("parent"), none.alias("child"), field_id)
    first = F.min_by("kind", F.when(~F.col("kind").isin("null", "record"), F.col("at")))
    one = children.filter(entity).groupBy(
        "schema_id", "position", "position_name", "position_doc", "child", "child_name", "child_doc").agg(
        F.bool_or("nullable").alias("nullable"), first.alias("kind"))
    nested = one.filter("kind IS NOT NULL").select(
        "schema_id", F.concat("position_name", "child_name").alias("name"),
        child_type(F.col("child_doc"), F.col("kind")).alias("field_type"), F.col("kind").alias("wire_type"),
        "nullable", F.col("position").alias("parent_position"), F.col("child").alias("position"),
        F.col("position_name").alias("parent"), F.col("child_name").alias("child"), field_id)
    return scalars.unionByName(nested).join(problems(registry, types, children), "schema_id", "left_anti").select(*ROW)


def binding_fields(rows: DataFrame, bindings: DataFrame, registry: DataFrame) -> DataFrame:
    """``binding_id, field, field_type`` of the revision each binding is linked to, for the
    checks of mappings and for suggestions. A field in both forms counts as the scalar.
    """
    linked = bindings.select(F.col("id").alias("binding_id"), F.col("avro_schema_id").alias("_id")).join(
        registry.select(F.col("id").alias("_id"), "schema_id"), "_id")
    return linked.join(rows, "schema_id").groupBy("binding_id", F.col("name").alias("field")).agg(
        F.min_by("field_type", F.col("parent").isNotNull()).alias("field_type"))
