"""Schema revisions with real texts, built from the parts: their fields as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.plans.field_rows import binding_fields, entity_field_rows, unreadable
from workload import checking, feeds
from workload.feeds import table
from workload.registry import query

# Fields by the number of their part: a scalar, a union, a compound, and one that names
# the compound before it.
TYPE_TEXT = """CASE p_partkey % 4 WHEN 0 THEN '"string"' WHEN 1 THEN '["null", "long"]'
    WHEN 2 THEN concat('["null", {"type": "record", "name": "R', p_partkey, '", "fields": [',
      '{"name": "Street", "type": ["null", "string"]}, {"name": "Lat", "type": "double", "doc": "Data:Double"}]}]')
    ELSE concat('["null", "sales.R', p_partkey - 1, '"]') END"""
HEADER = ('{"name": "ChangeEventHeader", "type": {"type": "record", "name": "Header", '
          '"fields": [{"name": "entityName", "type": "string"}]}}')


def registry(spark, sf):
    """One revision per twenty parts; every ninth text is cut short."""
    field = f"""struct(p_partkey, concat('{{"name": "Field_', p_partkey % 20, '", "doc": "Data:', {feeds.FIELD_TYPE},
        ':00N', p_partkey, '", "type": ', {TYPE_TEXT}, '}}') AS text)"""
    one = table(spark, sf, "part").selectExpr("p_partkey div 20 AS id", f"{field} AS field")
    # At most twenty fields to a revision.
    whole = one.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("field"))["text"], ", ").alias("fields"))
    text = F.concat(
        F.lit('{"type": "record", "namespace": "sales", "name": "E'), "id", F.lit(f'", "fields": [{HEADER}, '), "fields",
        F.when(F.col("id") % 9 == 4, "").otherwise("]}"))
    return whole.select("id", F.concat(F.lit("F"), "id").alias("schema_id"), text.alias("schema_json"))


FIELD_ROWS_SQL = f"""base AS (
  SELECT p_partkey // 20 AS b, p_partkey % 4 AS t, 'Field_' || p_partkey % 20 AS name, '00N' || p_partkey AS field_id,
    row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey)::INTEGER AS place, {feeds.FIELD_TYPE} AS field_type
  FROM part WHERE (p_partkey // 20) % 9 <> 4),
field_rows AS (
  SELECT b, name, CASE WHEN field_type NOT IN ('Address', 'Location', 'PersonName') THEN field_type
      WHEN t = 0 THEN 'Text' ELSE 'Integer' END AS field_type,
    CASE t WHEN 0 THEN 'string' ELSE 'long' END AS wire_type, t = 1 AS nullable, -1 AS parent_position,
    place AS position, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS child, field_id
  FROM base WHERE t < 2
  UNION ALL
  SELECT b, name || c.child, c.field_type, c.wire_type, c.nullable, place, c.spot, name, c.child, field_id
  FROM base, (VALUES ('Street', 'Text', 'string', true, 0), ('Lat', 'Double', 'double', false, 1))
    c(child, field_type, wire_type, nullable, spot) WHERE t >= 2)"""


@query("entity_fields", f"WITH {FIELD_ROWS_SQL} SELECT 'F' || b AS schema_id, * EXCLUDE (b) FROM field_rows")
def entity_fields(spark, sf):
    return entity_field_rows(registry(spark, sf))


@query("unreadable_schemas", """
SELECT DISTINCT 'F' || p_partkey // 20 AS schema_id, 'no JSON' AS problem FROM part WHERE (p_partkey // 20) % 9 = 4""")
def unreadable_schemas(spark, sf):
    return unreadable(registry(spark, sf))


def fields(spark, sf):
    """The fields of every binding, each linked to the revision of its own number."""
    revisions = registry(spark, sf)
    linked = revisions.select("id", F.col("id").alias("avro_schema_id"))
    return binding_fields(entity_field_rows(revisions), linked, revisions)


@query("mapping_check_registry", "WITH " + FIELD_ROWS_SQL + ", " + checking.CHECKED_SQL.replace(
    feeds.FIELDS_SQL, "fields AS (SELECT b AS binding_id, name AS field, field_type FROM field_rows)")
    + " SELECT * FROM verdicts")
def mapping_check_registry(spark, sf):
    return q.check_mappings(feeds.mappings(spark, sf), fields(spark, sf), feeds.columns(spark, sf)).drop("reason")
